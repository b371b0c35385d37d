"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A document is a bag of terms (pairs of neighbouring words, weighed by their count). For each of
SAMPLES independent draws, every term k of weight S has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all
functions of (k, draw) only. With t = floor(ln S / r + b), the term's level is
ln a = ln c - r (t - b + 1), and the draw's sample is the (k, t) of least level. Two documents have
the same sample with a probability that equals their generalised Jaccard similarity, the sum
of the terms' lesser weights over the sum of their greater ones.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, mix_int, partitions, staged

#: Independent draws of a fingerprint.
SAMPLES = 64
#: Gamma(2, 1) is drawn as one of so many equally likely values.
QUANTILES = 4096
#: Words end at blank and U+0009 to U+000D.
_SPACES = r"[\x20\x09-\x0D]+"


def gamma_quantiles(n: int = QUANTILES) -> list[float]:
    """The n midpoint quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x."""
    out, x = [], 0.0
    for i in range(n):
        p = (i + 0.5) / n
        low, high = x, max(1.0, 2 * x)
        while 1 - (1 + high) * math.exp(-high) < p:
            high *= 2
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
        out.append(x)
    return out


def gamma_table(spark: SparkSession) -> Column:
    """Quantiles of Gamma(2, 1), then their inverses, then their logarithms, in one array.

    It is a scalar subquery, so that plans hold a reference and not the numbers.
    """
    gamma = gamma_quantiles()
    numbers = [*gamma, *(1 / g for g in gamma), *(math.log(g) for g in gamma)]
    return spark.range(1).select(F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>").alias("gamma")).scalar()


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def terms(words: Column, version: int) -> Column:
    """Hashes of all pairs of neighbouring words, with the version in their last bit.

    A lone word is a term itself.
    """
    n = F.greatest(F.size(words) - 1, F.lit(1))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(version)))


def samples(h: Column, log_weight: Column, gamma: Column, draws: int = SAMPLES) -> list[Column]:
    """For each draw, level and identity of (term, t) in one integer, so that the least wins."""
    out = []
    for d in range(draws):
        x = F.xxhash64(h.bitwiseXOR(F.lit(mix_int(d + 1) - (1 << 63))))
        i = x.bitwiseAND(F.lit(QUANTILES - 1)).cast("int")
        j = F.shiftright(x, 12).bitwiseAND(F.lit(QUANTILES - 1)).cast("int")
        b = F.shiftrightunsigned(x, 24).cast("double") * F.lit(2.0**-40)
        # most terms come once, and then t is 0
        t = F.when(log_weight == 0, F.lit(0).cast("long")).otherwise((log_weight * F.get(gamma, i + F.lit(QUANTILES)) + b).cast("long"))
        level = F.get(gamma, j + F.lit(2 * QUANTILES)) - F.get(gamma, i) * (t.cast("double") - b + F.lit(1.0))
        # levels lie between -64 and 64; 26 bits of their fraction are kept
        high = F.shiftleft(((level + F.lit(64.0)) * F.lit(2.0**26)).cast("long"), 29)
        # t is below 2^12, so the product fits; it moves all of the 29 bits that name the sample
        name = x.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << 29) - 1))
        out.append(high.bitwiseOR(name))
    return out


def signatures(rows: DataFrame, keys: list[str], texts: list[str], draws: int = SAMPLES) -> DataFrame:
    """keys, and for each of one or two texts of a row its signature: an array of 16-bit samples.

    rows must be partitioned by (a subset of) keys, or a shuffle puts them so; keys tell rows
    apart. The bags are made within a row, so that no term is shuffled: terms are sorted, and the
    places where runs end give their counts. Terms that both texts have equally often are drawn
    for once. Texts without words have a signature of zeros, which others have but by chance.
    """
    one = lambda frame, **columns: frame.select(*keys, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("x"))
    # the one-row generators keep Spark from evaluating an array again for each of its elements
    held = one(rows, **{f"w{v}": words(F.col(t)) for v, t in enumerate(texts)})
    held = one(held, h=F.sort_array(F.concat(*[terms(F.col(f"x.w{v}"), v) for v in range(len(texts))])))
    ends = F.filter(F.sequence(F.lit(0), F.size("x.h") - 1), lambda i: (i == F.size("x.h") - 1) | (F.get("x.h", i) != F.get("x.h", i + 1)))
    held = one(held, h=F.col("x.h"), ends=F.when(F.size("x.h") > 0, ends).otherwise(F.array().cast("array<int>")))
    held = one(held, bag=F.transform("x.ends", lambda e, j: F.struct(F.get("x.h", e).alias("h"), (e - F.when(j == 0, F.lit(-1)).otherwise(F.get("x.ends", j - 1))).alias("n"))))
    same = lambda e, o: F.coalesce((o["h"].bitwiseXOR(e["h"]) == 1) & (o["n"] == e["n"]), F.lit(False))
    mark = lambda e, i: F.when(same(e, F.get("x.bag", i + 1)) & (e["h"].bitwiseAND(F.lit(1)) == 0), 3).when(same(e, F.get("x.bag", i - 1)) & (e["h"].bitwiseAND(F.lit(1)) == 1), 0).otherwise(e["h"].bitwiseAND(F.lit(1)).cast("int") + 1)
    bag = F.filter(F.transform("x.bag", lambda e, i: F.struct(F.shiftright(e["h"], 1).alias("h"), e["n"].alias("n"), mark(e, i).alias("of"))), lambda e: e["of"] > 0)
    held = held.select(*keys, F.explode_outer(bag).alias("x")).select(*keys, F.col("x.of").alias("of"), F.col("x.h").alias("h"), F.ln(F.col("x.n").cast("double")).alias("log_weight"), gamma_table(rows.sparkSession).alias("gamma"))
    least = held.groupBy(*keys, "of").agg(*[F.min(c).alias(f"s{d}") for d, c in enumerate(samples(F.col("h"), F.col("log_weight"), F.col("gamma"), draws))])
    names = [(v, d, f"s{v}_{d}") for v in range(len(texts)) for d in range(draws)]
    least = least.groupBy(*keys).agg(*[F.min(F.when(F.col("of") != 2 - v, F.col(f"s{d}"))).alias(n) for v, d, n in names])
    sample = lambda n: F.coalesce(F.col(n).bitwiseAND(F.lit(0xFFFF)), F.lit(0)).cast("int")
    return least.select(*keys, *[F.array(*[sample(n) for w, _, n in names if w == v]).alias(f"signature{v}") for v in range(len(texts))])


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a sample."""
    return F.lower(F.concat_ws("", F.transform(signature, lambda s: F.lpad(F.hex(s), 4, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """The share of draws with the same sample, an estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def with_next(docs: DataFrame) -> DataFrame:
    """The following document of each, in descending order of doc_id; the first follows the last.

    Returns doc_id, k, kh, n_chars, rows, and the next document's next_k and next_kh. Null doc_ids
    come last; documents of one doc_id are in order of their texts' hashes; repeated rows are one
    document with rows of them. Only keys are sorted, in ranges; one row a range closes the gaps.
    """
    spark = docs.sparkSession
    base = keyed(docs).groupBy("doc_id", "k", "kh").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("rows"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("kh")]
    base = staged(base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "order")
    base = base.withColumn("range", F.shiftright("seq", 33)).withColumn("own", F.struct("k", "kh"))
    heads = base.groupBy("range").agg(F.min_by("own", "seq").alias("head"))
    by_range = Window.orderBy("range")
    every = Window.partitionBy()
    heads = heads.select(F.col("range").alias("of"), F.coalesce(F.lead("head").over(by_range), F.min_by("head", "range").over(every)).alias("following"))
    base = base.withColumn("after", F.lead("own").over(Window.partitionBy("range").orderBy("seq")))
    found = base.join(heads, F.col("range") == F.col("of")).withColumn("next", F.coalesce("after", "following"))
    return found.select("doc_id", "k", "kh", "n_chars", "rows", F.col("next.k").alias("next_k"), F.col("next.kh").alias("next_kh"))


def edited_likeness(docs: DataFrame, draws: int = SAMPLES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses.

    The edited text has the last third of a document replaced by as many first code points of the
    next document. Whole texts count; null texts are empty; an empty table gives no rows; repeated
    rows give a row each; columns but doc_id and text are ignored. Texts move by hash of their
    keys, once whole and once in the part that the document before takes.
    """
    order = staged(with_next(docs), "next")
    text = keyed(docs).select("k", "kh", "text")
    given = order.select(F.col("next_k").alias("k"), F.col("next_kh").alias("kh"), F.col("k").alias("to_k"), F.col("kh").alias("to_kh"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"))
    heads = text.join(given, ["k", "kh"]).select("to_k", "to_kh", F.expr("substring(text, 1, wanted)").alias("head")).dropDuplicates(["to_k", "to_kh"])
    mine = text.join(order, ["k", "kh"])
    both = mine.join(heads, (F.col("k") == F.col("to_k")) & (F.col("kh") == F.col("to_kh")))
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep.cast("int")), F.col("head")))
    about = ["k", "kh", "doc_id", "n_chars", "rows", "next_k", "next_kh"]
    both = both.select(*about, F.sha2(F.col("edited"), 256).alias("edited_sha256"), "text", "edited")
    found = staged(signatures(both, [*about, "edited_sha256"], ["text", "edited"], draws), "signatures")
    after = found.select(F.col("k").alias("next_k"), F.col("kh").alias("next_kh"), F.col("signature0").alias("following"))
    out = found.join(after, ["next_k", "next_kh"])
    out = out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("signature0")).alias("fingerprint"), as_text(F.col("signature1")).alias("edited_fingerprint"), likeness(F.col("signature0"), F.col("signature1")).alias("near_edited"), likeness(F.col("signature0"), F.col("following")).alias("near_next"), "rows")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "again")
