import pytest
from pyspark.sql import functions as F

from attest.functions import text as T


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("R$ 1.500,00", "1500"), ("1,500.00", "1500"), ("1500.0", "1500"), ("0,75", "0.75"), ("1.2.3", None), ("007", "7"), ("1.000.000", "1000000"), ("12,345", "12345"), (".5", "0.5"), ("5.", "5"), ("abc", None), (",", None), ("1.2.3,4", "123.4"), (None, None)])
def test_canonical_number(spark, raw, want):
    assert one(spark, raw, T.canonical_number) == want


@pytest.mark.parametrize(("text", "want"), [("R$ 1.500,00 e 30% ou 30 por cento", ["1500", "30%", "30%"]), ("10x é5 1.5000 5 200 12a34", ["10", "1500", "5200", "12"]), (None, []), ("nada", [])])
def test_extract_numbers(spark, text, want):
    assert one(spark, text, T.extract_numbers) == want


@pytest.mark.parametrize(("text", "want"), [("O atendimento funciona 24 horas por dia, todos os dias.", ["atend", "funciona", "24", "hor", "dia", "tod", "dia"]), ("straße", ["stra", "e"]), ("entrega entregas entregam", ["entrega", "entreg", "entreg"]), (None, []), ("ﬁm ½", ["fim", "1", "2"])])
def test_tokenize(spark, text, want):
    got = one(spark, text, T.tokenize)
    assert got == [w for w in want if w != "e"]


@pytest.mark.parametrize(("text", "want"), [("Sr. Silva mora aqui. Art. 5 vale.\n- um\n• dois", ["Sr. Silva mora aqui.", "Art. 5 vale.", "um", "dois"]), ("Custa 1.5 hoje. Amanhã não", ["Custa 1.5 hoje.", "Amanhã não"]), ("  ", []), (None, [])])
def test_split_sentences(spark, text, want):
    assert one(spark, text, T.split_sentences) == want


def test_normalize_folds_like_unicode(spark):
    import unicodedata

    chars = [chr(p) for p in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]]
    got = [r[0] for r in spark.createDataFrame([(f"a{c}b",) for c in chars], "t string").select(T.normalize(F.col("t"))).collect()]
    want = [" ".join("".join(x for x in unicodedata.normalize("NFKD", f"a{c}b") if not unicodedata.combining(x)).lower().split()) for c in chars]
    assert got == want


def test_normal_form_of_every_character(spark):
    import re
    import unicodedata

    points = [p for p in range(0x21, 0x32000) if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    rows = spark.createDataFrame([(p, "a" + chr(p) + "b") for p in points], "point int, text string")
    got = {r["point"]: r["out"] for r in rows.select("point", T.normalize(F.col("text")).alias("out")).collect()}

    def plain(text):
        kept = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", kept.lower()).strip()

    wrong = [hex(p) for p in points if got[p] != plain("a" + chr(p) + "b")]
    assert not wrong, wrong[:20]
