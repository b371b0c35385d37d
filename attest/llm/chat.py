"""Reply trees to training conversations.

Iterative self-joins walk from every leaf to its root. Each round doubles the distance of the
links that a node holds, so the number of joins is the logarithm of the longest path.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

#: Fixed control strings of the template.
BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
#: An opener, any number of backslashes, and a closer. Escaping puts one more backslash between.
_CONTROL = r"(<</|<<|</|<|\[/|\[)(\\*)(s>|INST\]|SYS>>)"
_ESCAPED = re.compile(r"(<</|<<|</|<|\[/|\[)\\(\\*)(s>|INST\]|SYS>>)")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: Column) -> Column:
    """Breaks control strings with a backslash; `unescape` restores them exactly."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def branches(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees.

    messages has the columns tree_id, message_id, parent_id (null at a root), role, text, score.
    Message ids are unique within a tree; tree ids may be null. A parent that is missing makes its
    child a root; messages on a cycle, and those below one, have no root and are in no path. Null scores
    count as 0. Other columns are ignored. An empty table gives no paths.

    Returns tree_id, leaf_id, rank (1 is best: highest mean score, then longest, then smallest
    leaf id), n_turns and turns, an array of (role, text) from root to leaf.
    """
    node = messages.select("tree_id", "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = node.select("tree_id", "message_id", "parent_id")
    tree = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    parent = ids.select(F.col("tree_id").alias("pt"), F.col("message_id").alias("pm"))
    # each message's ancestor at the distance of the round; messages without one are left out
    link = staged(ids.join(parent, tree("tree_id", "pt") & (F.col("parent_id") == F.col("pm"))).select("tree_id", "message_id", F.col("pm").alias("up")), "links")
    has_child = link.select(F.col("tree_id").alias("ct"), F.col("up").alias("cm")).distinct()
    paths = staged(ids.join(has_child, tree("tree_id", "ct") & (F.col("message_id") == F.col("cm")), "left_anti").select("tree_id", F.col("message_id").alias("leaf_id"), F.col("message_id").alias("node_id"), F.lit(0).cast("long").alias("depth")), "paths")
    step, most = 1, ids.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    while True:
        jump = link.select(F.col("tree_id").alias("jt"), F.col("message_id").alias("jm"), F.col("up").alias("far"))
        further = staged(paths.join(jump, tree("tree_id", "jt") & (F.col("node_id") == F.col("jm"))).select("tree_id", "leaf_id", F.col("far").alias("node_id"), (F.col("depth") + step).alias("depth")), "paths")
        if further.isEmpty():
            break
        if step >= most:  # no path is longer than its tree: these run round a cycle
            lost = further.select(F.col("tree_id").alias("lt"), F.col("leaf_id").alias("ll")).distinct()
            paths = paths.join(lost, tree("tree_id", "lt") & (F.col("leaf_id") == F.col("ll")), "left_anti")
            break
        paths = paths.unionByName(further)
        link = staged(link.join(jump, tree("tree_id", "jt") & (F.col("up") == F.col("jm"))).select("tree_id", "message_id", F.col("far").alias("up")), "links")
        step *= 2
    held = node.select(F.col("tree_id").alias("nt"), F.col("message_id").alias("nm"), "role", "text", "score")
    whole = (
        paths.join(held, tree("tree_id", "nt") & (F.col("node_id") == F.col("nm")))
        .groupBy("tree_id", "leaf_id")
        .agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("o"), "role", "text"))).alias("turns"))
    )
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), F.desc("n_turns"), "leaf_id")
    return whole.select("tree_id", "leaf_id", F.row_number().over(best).alias("rank"), "n_turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each path as one text, with the spans of code points that carry the loss.

    A turn is `<s>[INST]role[/INST]text</s>` with role and text escaped, so no control string
    inside them can end a turn. Adds formatted and loss_spans, an array of (first, last + 1).
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(BEGIN + HEAD), escape(t["role"]), F.lit(TAIL)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    grown = F.aggregate(
        "parts",
        start,
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("first"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("last"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    text = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    return paths.withColumn("parts", parts).withColumn("formatted", text).withColumn("loss_spans", grown["spans"]).drop("parts")


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of one formatted text."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def read_back(df: DataFrame, key: str) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text alone."""
    import hashlib

    def each(batches):
        for batch in batches:
            rows = []
            for k, text, spans in zip(*(batch.column(c).to_pylist() for c in (key, "formatted", "loss_spans")), strict=True):
                turns = parsed(text)
                learnt = [unescape(text[s["first"] : s["last"]]) for s in spans]
                rows.append((k, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, learnt)), hashlib.sha256("".join(learnt).encode()).hexdigest(), len(text)))
            names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias(key), "formatted", "loss_spans").mapInArrow(each, f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
