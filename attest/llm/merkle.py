"""A manifest of a table as Merkle trees: one tree for each group of rows, and one over their roots."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, partitions, ship, staged

#: Bytes of a digest in hex, the form in which digests are hashed again.
HEX = 64
STEPS = "array<struct<place:int,others:binary>>"
ENDS = "struct<subroot:binary,root:binary>"
_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))
_ENDS = pa.struct([("subroot", pa.binary()), ("root", pa.binary())])


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field is `-` if null, else its UTF-8 byte count, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `at`, their place in this order, nulls first; strings are ordered by bytes.

    Rows are dealt by ranges and sorted there; a row's number is its number in its range and the
    rows of the ranges before. Rows that are equal in order keep that of their columns `n`, if
    there is one. The result is staged, so that it stays the same when it is read again.
    """
    spark = rows.sparkSession
    by = [*order, *(["n"] if "n" in rows.columns else [])]
    own = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    own = staged(own, "ranked").withColumns({"range": F.shiftright("id", 33), "inside": F.col("id").bitwiseAND((1 << 33) - 1)})
    # a row for each range: as many as there are partitions, whatever the data
    held = own.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(F.broadcast(held.select("range", before.alias("before"))), "range").select(*rows.columns, (F.col("before") + F.col("inside")).alias("at"))


# ---- one block of a tree, in numpy ----------------------------------------------------


def heights(nodes: int, fanout: int, most: int) -> int:
    """Levels above `nodes` nodes until one is left, at most `most`."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def raised(digests: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a matrix of hex digests (n x 64 bytes); the last run may be short."""
    whole = len(digests) // fanout
    runs = [memoryview(r) for r in digests[: whole * fanout].reshape(whole, fanout * HEX)]
    if whole * fanout < len(digests):
        runs.append(memoryview(digests[whole * fanout :].reshape(-1)))
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, HEX)


def levels_of(digests: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    out = [digests]
    for _ in range(levels):
        out.append(raised(out[-1], fanout))
    return out


def siblings(digests: np.ndarray, at: np.ndarray, fanout: int) -> tuple[np.ndarray, list[bytes]]:
    """Places in their runs of the nodes `at` of a level, and the other digests of each run.

    In a run the others are start + 0, 1, ... but for the node's own place: one gather for all
    nodes in whole runs, one for each length of the last.
    """
    start = at // fanout * fanout
    place, size = at - start, np.minimum(fanout, len(digests) - start)
    out: list[bytes] = [b""] * len(at)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        step = np.arange(n - 1)
        others = start[own, None] + step + (step >= place[own, None])
        held = digests[others].reshape(len(own), (n - 1) * HEX).tobytes()
        width = int(n - 1) * HEX
        for i, k in enumerate(own):
            out[k] = held[i * width : (i + 1) * width]
    return place, out


def fold(digest: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a hex digest and its siblings make, level by level."""
    for place, others in steps:
        cut = place * HEX
        digest = hashlib.sha256(others[:cut] + digest + others[cut:]).hexdigest().encode()
    return digest


def matrix(column: pa.Array) -> np.ndarray:
    """Hex digests (n x 64) of binary ones of 32 bytes."""
    if not len(column):
        return np.zeros((0, HEX), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()).hex().encode(), np.uint8).reshape(-1, HEX)


# ---- trees in rounds --------------------------------------------------------------------


def _block_roots(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """The next round's nodes (tree, at, of, digest): one for each block of fanout ** height nodes."""
    size = fanout**height

    def up(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        of, at = block["of"][0].as_py(), block["at"][0].as_py()
        top = levels_of(matrix(block["digest"].combine_chunks()), fanout, heights(of, fanout, height))[-1]
        return pa.table({"tree": block["tree"][:1], "at": [at // size], "of": [-(-of // size)], "digest": pa.array([bytes.fromhex(top[0].tobytes().decode())], pa.binary())})

    keyed = nodes.select("tree", "at", "of", "digest", F.expr(f"at div {size}").alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(up, "tree long, at long, of long, digest binary")


def _steps(block: pa.Table, fanout: int, height: int) -> list[list[dict]]:
    """Steps of every row of a sorted block up to the block's root."""
    levels = levels_of(matrix(block["digest"].combine_chunks()), fanout, heights(block["of"][0].as_py(), fanout, height))
    at, out = np.arange(len(block)), [[] for _ in range(len(block))]
    for digests in levels[:-1]:
        place, others = siblings(digests, at, fanout)
        for own, p, o in zip(out, place.tolist(), others):
            own.append({"place": p, "others": o})
        at = at // fanout
    return out


def _beside(nodes: DataFrame, above: DataFrame, columns: list[str], fanout: int, height: int):
    """Blocks of nodes, each with the row of its root in `above` (tree, at, ends, steps)."""
    keyed = nodes.select(*columns, "tree", "at", "of", "digest", F.expr(f"at div {fanout**height}").alias("block"))
    return keyed.groupBy("tree", "block").cogroup(above.select(F.col("tree").alias("above_tree"), F.col("at").alias("above_block"), "ends", "steps").groupBy("above_tree", "above_block"))


def _handed_down(nodes: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """nodes (tree, at) with ends and steps, from those of their blocks' roots."""

    def down(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        steps = top["steps"][0].as_py()
        made = pa.array([own + steps for own in _steps(block, fanout, height)], _STEPS)
        return pa.table({"tree": block["tree"], "at": block["at"], "ends": pa.array([top["ends"][0].as_py()] * len(block), _ENDS), "steps": made})

    return _beside(nodes, above, [], fanout, height).applyInArrow(down, f"tree long, at long, ends {ENDS}, steps {STEPS}")


def _grown(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Rounds of nodes (tree, at, of, digest) until each tree has one node."""
    rounds = [nodes]
    most = nodes.agg(F.max("of")).first()[0] or 0
    while most > 1:
        rounds.append(staged(_block_roots(rounds[-1], fanout, height), "nodes"))
        most = -(-most // fanout**height)
    return rounds


def manifest(rows: DataFrame, order: str, tree: str, digest: str = "leaf", claimed: str | None = None, fanout: int = 8, height: int = 4, paths: bool = False) -> DataFrame:
    """rows with leaf, subroot, root, proof_sha256, folded_root and verified, and steps if `paths`.

    Each value of `tree` (null included) has a tree over its rows' hex digests, by `order`, nulls
    first: while there are several nodes, every `fanout` neighbours, the last ones perhaps fewer,
    become the digest of their hex digests on end. Over the trees' roots, by `tree`, stands one
    more tree of that form. proof_sha256 is the digest of all siblings on the way from a leaf to
    the root, left to right, level by level. folded_root is made of these siblings and `claimed`,
    or the leaf where that is null or not given; verified says whether it is the root. `steps` are
    the siblings with the node's place among them.

    Rows that are equal in `tree` and `order` follow each other as they were read; a table without
    rows gives none. Digests are worked on in aligned blocks of fanout ** height nodes, whatever
    the size of a tree, and a block's root is a node of the next round, so neither a task nor the
    driver holds a tree. Rows move with all their columns, so they should be keys and digests.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = [c for c in rows.columns if c not in (digest, claimed)]
    own = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.unhex(digest).alias("digest"), (F.unhex(claimed) if claimed else F.lit(None).cast("binary")).alias("claimed"), F.monotonically_increasing_id().alias("n"))
    by, key = f"k{kept.index(order)}", f"k{kept.index(tree)}"
    read = staged(own, "leaves")
    placed = ranked(read, key, by)
    named = staged(placed.groupBy(F.col(key).alias("name")).agg(F.min("at").alias("first"), F.count("*").alias("of")), "trees")
    trees = ranked(named, "first").withColumnRenamed("at", "tree")
    others = [f"k{i}" for i in range(len(kept)) if f"k{i}" != key]
    leaves = placed.join(trees, F.col(key).eqNullSafe(F.col("name"))).select(*others, "tree", (F.col("at") - F.col("first")).alias("at"), "of", "digest", "claimed")
    leaves = staged(leaves, "leaves")
    dropped(read)
    rounds = _grown(leaves, fanout, height)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest")
    # the number of trees is one row
    tops = _grown(staged(tops.crossJoin(F.broadcast(tops.agg(F.count("*").alias("of")))), "tops"), fanout, height)
    none = F.array().cast(STEPS)
    held = tops[-1].select("tree", "at", F.struct(F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root")).alias("ends"), none.alias("steps"))
    for nodes in tops[-2::-1]:
        held = staged(_handed_down(nodes, held, fanout, height), "paths")
    whole = held.select(F.col("at").alias("tree"), F.col("ends.root").alias("root"), "steps")
    held = rounds[-1].select("tree", "at", "digest").join(whole, "tree").select("tree", "at", F.struct(F.col("digest").alias("subroot"), "root").alias("ends"), "steps")
    for nodes in rounds[-2:0:-1]:
        held = staged(_handed_down(nodes, held, fanout, height), "paths")

    def down(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        ends, far = top["ends"][0].as_py(), [(s["place"], s["others"]) for s in top["steps"][0].as_py()]
        subroot, root = ends["subroot"].hex(), ends["root"].hex()
        digests, claims = block["digest"].to_pylist(), block["claimed"].to_pylist()
        ways = [[(s["place"], s["others"]) for s in near] + far for near in _steps(block, fanout, height)]
        proofs = [hashlib.sha256(b"".join(o for _, o in way)).hexdigest() for way in ways]
        folded = [fold((mine if claim is None else claim).hex().encode(), way).decode() for mine, claim, way in zip(digests, claims, ways)]
        out = {c: block[c] for c in others} | {"tree": block["tree"], "leaf": [d.hex() for d in digests], "subroot": [subroot] * len(block), "root": [root] * len(block), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
        return pa.table(out | ({"steps": pa.array([[{"place": p, "others": o} for p, o in way] for way in ways], _STEPS)} if paths else {}))

    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    made = ["leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean", *([f"steps {STEPS}"] if paths else [])]
    found = _beside(leaves, held, [*others, "claimed"], fanout, height).applyInArrow(down, ", ".join([*[f"{c} {kinds[c]}" for c in others], "tree long", *made]))
    found = found.join(trees.select(F.col("tree").alias("known"), "name"), F.col("tree") == F.col("known"))
    return found.select(*[(F.col("name") if f"k{i}" == key else F.col(f"k{i}")).alias(c) for i, c in enumerate(kept)], *[m.split(" ")[0] for m in made])
