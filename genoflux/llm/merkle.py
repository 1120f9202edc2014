"""A Merkle manifest of a dataset by lag and lead windows.

Each group's leaves are numbered by range parts, so no window holds a whole group: a level's windows are its runs of RUN
consecutive nodes. In a run, lag and lead columns of fixed offsets, masked by a node's slot and by the run's length, supply the
siblings on either side; the row in the first slot hashes the run to the node above. Levels go up until each group has one node; then
each node gets the siblings above it from its parent, from the top down.

A digest is the lowercase hex sha256 of its inputs' concatenation, other digests entering as hex text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes under one parent.
RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value (integers decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**other: Column) -> Column:
    """The digest of a row's FIELDS, of which those in `other` have another value."""
    return F.sha2(F.concat(*(encoded(other.get(f, F.col(f))) for f in FIELDS)), 256)


def numbered(scratch: Scratch, nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos (from 0, within the group, in order) and n (the group's size). Groups (not null) must be consecutive in this order. Rows
    are dealt by range and sorted within a part, so a row's number is its place in the part and the count of its group in earlier
    parts. Equal rows may stand in any order."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())  # so that a part's range can end among equal rows
    dealt = scratch.write(dealt.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return dealt.join(parts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds block (the run), left and right: the joined digests of the siblings before and after each node. nodes: g, pos, n, digest."""
    w = Window.partitionBy("g", "block").orderBy("pos")
    slot = F.col("pos") % RUN
    length = F.least(F.lit(RUN), F.col("n") - F.col("block") * RUN)
    left = [F.when(slot >= k, F.lag("digest", k).over(w)).otherwise("") for k in range(RUN - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("digest", k).over(w)).otherwise("") for k in range(1, RUN)]
    return nodes.withColumn("block", F.expr(f"pos div {RUN}")).withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def climbed(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """The tables of all levels, leaves first. A group is in them up to the level at which it has one node."""
    levels, widest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        below = with_siblings(levels[-1].where("n > 1")).where(F.col("pos") % RUN == 0)
        up = below.select("g", F.col("block").alias("pos"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(scratch.write(up))
        widest = -(-widest // RUN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """g, digest: the one node that remains of each group."""
    return reduce(DataFrame.unionByName, (x.where("n = 1").select("g", "digest") for x in levels))


def paths(scratch: Scratch, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with `path`: the siblings (left, right) at each level, from their own up, then those of `above` (g, path), which is
    what is over a group's last node. Each level's table but the leaves' is written."""
    parents = None
    for i in range(len(levels) - 1, -1, -1):
        alone = levels[i].where("n = 1").join(above, "g")
        out = alone
        if parents is not None:
            own = with_siblings(levels[i].where("n > 1")).join(parents.select("g", F.col("pos").alias("block"), F.col("path").alias("upper")), ["g", "block"])
            own = own.withColumn("path", F.concat(F.array(F.struct("left", "right")), "upper"))
            out = own.select(*alone.columns).unionByName(alone)
        parents = scratch.write(out.select("g", "pos", "path")) if i else out
    return parents


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof(path: str = "path") -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, proof_sha256, and
    folded_root and verified, which hold the siblings against the leaf that the row has with `claimed_text` in place of its text.

    A source's leaves ascend by doc_id (null first, ties by leaf), and sources by their UTF-8 bytes (null first). Nulls in any column
    have their own code in a leaf. Rows that repeat are leaves each, with one and the same leaf digest; which of their places a row has is then open.
    Texts are hashed whole. A source of one row is its own subroot, one source's subroot is the root; an empty table gives an
    empty one. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    claimed = leaf() if claimed_text is None else leaf(text=claimed_text)
    rows = docs.select(*FIELDS).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("digest"), claimed.alias("claimed"))
    rows = scratch.write(rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed"))))  # texts are read once
    leaves = scratch.write(numbered(scratch, rows.withColumn("g", encoded(F.col("source"))), "g", ["source", "doc_id", "digest"]))
    levels = climbed(scratch, leaves)
    subroots = scratch.write(tops(levels).join(leaves.where("pos = 0").select("g", "source"), "g"))
    sources = scratch.write(numbered(scratch, subroots.select(F.lit("").alias("g"), "source", F.col("g").alias("of"), "digest"), "g", ["source"]))
    upper = climbed(scratch, sources)
    root = tops(upper).select(F.col("digest").alias("root"))
    over = paths(scratch, upper, docs.sparkSession.createDataFrame([("",)], "g string").select("g", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path")))
    over = scratch.write(over.select(F.col("of").alias("g"), "path", F.col("digest").alias("subroot")))
    found = root.first()
    out = paths(scratch, levels, over.select("g", "path")).join(over.select("g", "subroot"), "g")
    out = out.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", F.lit(found.root if found else None).cast("string").alias("root"), proof().alias("proof_sha256"), folded(F.coalesce("claimed", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
