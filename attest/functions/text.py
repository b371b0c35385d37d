"""Text functions on columns: normal form, tokens, sentences and figures."""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ABBREVIATIONS, CURRENCY, FIGURE, LEAST_STEM, PERCENT, STOPWORDS, SUFFIXES, WORD

#: What Python's str methods call white space, as a Java character class.
_BLANK = r"[\s\x1c-\x1f\x85]"


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Characters with a compatibility decomposition, and the class of combining marks.

    One-to-one folds make a translation, longer ones a map. Hangul syllables are left to
    `_jamo`, which needs no table of them. No character beyond U+2FFFF has a decomposition.
    """
    single, folded, longer, marks = [], [], [], []
    for point in range(0x80, 0x30000):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        if unicodedata.combining(char):
            marks.append(point)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if len(plain) == 1:
            single.append(char)
            folded.append(plain)
        else:
            longer.append((char, plain))
    runs, start = [], None
    for i, point in enumerate(marks):
        start = point if start is None else start
        if i + 1 == len(marks) or marks[i + 1] != point + 1:
            runs.append(f"\\x{{{start:x}}}-\\x{{{point:x}}}")
            start = None
    return "".join(single), "".join(folded), tuple(longer), "[" + "".join(runs) + "]"


def _jamo(char: Column) -> Column:
    """The two or three jamo of a Hangul syllable, by their place in the alphabet."""
    at = F.ascii(char) - 0xAC00
    part = lambda first, n, i: F.element_at(F.split(F.lit("".join(map(chr, range(first, first + n)))), ""), i.cast("int") + 1)
    tail = F.when(at % 28 > 0, part(0x11A8, 27, F.greatest(at % 28, F.lit(1)) - 1)).otherwise("")
    return F.concat(part(0x1100, 19, F.floor(at / 588)), part(0x1161, 21, F.floor(at % 588 / 28)), tail)


def normalize(text: Column) -> Column:
    """Lower case without accents, white space as single blanks; null gives the empty string."""
    single, folded, longer, marks = _folds()
    # Java may know fewer characters than Python does
    marks = f"[[\\p{{M}}\\p{{Cn}}]&&{marks}]"
    out = F.translate(F.coalesce(text, F.lit("")), single, folded)
    # classes begin with a quick test, as Java asks the members of a long one one after another
    several = "[[^\\x00-\\x7f]&&[\uac00-\ud7a3" + "".join(c for c, _ in longer) + "]]"
    # a map written as a string stays one literal in every plan
    table = F.str_to_map(F.lit("\x02".join(f"{c}\x01{p}" for c, p in longer)), F.lit("\x02"), F.lit("\x01"))
    many = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.between("\uac00", "\ud7a3"), _jamo(c)).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    out = F.when(out.rlike(several), many).otherwise(out)
    out = F.lower(F.regexp_replace(out, marks, ""))
    return F.trim(F.regexp_replace(out, f"(?U){_BLANK}+", " "))


def stem(token: Column) -> Column:
    """Removes the first suffix of the list that leaves enough; words with digits stay."""
    out = F.when(token.rlike("[0-9]"), token)
    for suffix, least in SUFFIXES:
        out = out.when(token.endswith(suffix) & (F.length(token) >= max(least, len(suffix) + LEAST_STEM)), F.substring(token, F.lit(1), F.length(token) - len(suffix)))
    return out.otherwise(token)


def words(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(WORD), F.lit(0))


def tokenize(text: Column, drop_stopwords: bool = True, stemming: bool = True) -> Column:
    """Normalised words, in order, duplicates kept; stopwords go before stemming."""
    out = words(text)
    if drop_stopwords:
        out = F.filter(out, lambda t: ~t.isin(*sorted(set(STOPWORDS))))
    return F.transform(out, stem) if stemming else out


def without_figures(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("[0-9]"))


@cache
def abbreviation() -> str:
    """A pattern of an abbreviation after a blank; its letters may have accents or be capitals."""
    forms = []
    for word in ABBREVIATIONS:
        form = ""
        for letter in word:
            same = [chr(p) for p in range(0x80, 0x250) if unicodedata.normalize("NFKD", chr(p))[0].lower() == letter and all(map(unicodedata.combining, unicodedata.normalize("NFKD", chr(p))[1:]))]
            form += f"[{letter}{letter.upper()}{''.join(same)}]"
        forms.append(form)
    return rf"(?:^|[\s(])(?:{'|'.join(forms)})\."


def split_sentences(text: Column) -> Column:
    """Sentences, not cut at decimals and abbreviations; lines are sentences of their own.

    An abbreviation keeps its sentence together, with one blank after it.
    """
    ahead = "(?=[A-ZÀ-ÖØ-Þ0-9])"
    held = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U)^{_BLANK}+|{_BLANK}+$", "")
    # one character before and one after are looked at first: the list of abbreviations is tried at few places
    held = F.regexp_replace(held, f"(?U)(?<=[.])(?={_BLANK})(?<={abbreviation()}){_BLANK}+{ahead}", " ")
    parts = F.split(held, f"(?U)(?<=[.!?;])(?={_BLANK})(?<!{abbreviation()}){_BLANK}+{ahead}", -1)
    lines = F.flatten(F.transform(parts, lambda p: F.split(p, "\n", -1)))
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t-•*"))), lambda x: x != "")


def canonical_number(raw: Column) -> Column:
    """One form for each value, such as 1500 for 1.500,00; null where there is no number."""
    kept = F.regexp_replace(raw, r"(?U)[^\d.,]", "")
    dot, comma = kept.contains("."), kept.contains(",")
    tail_dot, tail_comma = F.regexp_extract(kept, r"\.([^.]*)$", 1), F.regexp_extract(kept, ",([^,]*)$", 1)
    head_comma = F.substring(kept, F.lit(1), F.length(kept) - F.length(tail_comma) - 1)
    none = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    point = (
        F.when(dot & comma & (F.length(tail_dot) < F.length(tail_comma)), none(kept, ","))
        .when(dot & comma, F.replace(none(kept, "."), F.lit(","), F.lit(".")))
        .when(comma & F.length(tail_comma).isin(1, 2), F.concat(none(head_comma, ","), F.lit("."), tail_comma))
        .when(comma, none(kept, ","))
        .when(dot & (F.length(tail_dot) == 3) & (F.length(kept) > 4), none(kept, "."))
        .otherwise(kept)
    )
    whole = F.regexp_replace(F.regexp_extract(point, r"^(\d*)", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(point, r"\.(\d*)$", 1), "0+$", "")
    text = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(point.rlike(r"^(\d+\.?\d*|\.\d+)$"), text)


def extract_numbers(text: Column) -> Column:
    """Canonical figures in order, duplicates kept; percentages end in %."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?iU)(?<![\w]){CURRENCY}{FIGURE}\s*{PERCENT}?"), F.lit(0))

    def one(m: Column) -> Column:
        number = canonical_number(F.regexp_extract(m, f"(?iU)^{CURRENCY}{FIGURE}", 1))
        return F.concat(number, F.when(m.rlike(f"(?iU){PERCENT}$"), "%").otherwise(""))

    return F.filter(F.transform(found, one), lambda n: n.isNotNull())


