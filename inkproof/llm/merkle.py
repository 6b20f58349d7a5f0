"""Merkle manifest of a table: each row's proof to one root, by butterfly exchange between blocks of leaves.

Leaves of a group ascend by a key; while multiple nodes remain, every ``FANOUT`` consecutive ones
(the last run: fewer) are hashed to their parent. Leaves get their rank without gathering a group:
they are dealt out by key ranges and written, ranges count their rows, and offsets are summed
over the ranges. An aligned block of ``FANOUT ** LOCAL`` leaves is then one row, which hashes its
own subtree and gives its leaves their lower proofs; it is written as rows of leaves, as readers take
thousands of rows at a time. For the upper levels blocks exchange their nodes:
in round j, aligned groups of ``FANOUT`` subtrees of FANOUT^j blocks swap their roots, each block with
those at its own place in the others, and each hashes the common ancestor itself. So after the last
round every block has its whole upper proof, and nothing is handed down. In a last, smaller
subtree each block also serves the places that it lacks.

Groups' roots, ordered by group, are the leaves of one more tree of the same kind.

A null column counts as ``-``. Rows of the same key are ordered by their leaf; copies of a row have
leaves of their own. Null keys come first, null groups too. An empty table gives no rows. Only the
named columns are read. At 100 TB the leaves are some 1 % of the input, and blocks a 500th of the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shape import settled
from .common import materialise

FANOUT, LOCAL = 8, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROOF = "array<struct<left: string, right: string>>"


def digest(*columns: Column) -> Column:
    """The leaf: sha256 over all values, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    known = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(F.coalesce(known(c.cast("string")), F.lit("-")) for c in columns)), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else: what the tampering does."""
    return F.translate(text, _UPPER, _LOWER)


def _hashed(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _siblings(nodes: Column, place: Column) -> Column:
    """What stands before and after ``place`` (from 0) in a run of nodes."""
    return F.struct(F.array_join(F.slice(nodes, 1, place), "").alias("left"), F.array_join(F.slice(nodes, place + 2, F.size(nodes)), "").alias("right"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def ranked(leaves: DataFrame, key: str) -> DataFrame:
    """``leaves`` (with ``group``, ``leaf``) and ``rank``, from 0 in each group by ``key``, ``leaf``; and ``n``, the group's size.

    A range of keys is a task's, however large its group is; only counts for each range and group are summed up.
    """
    spread = leaves.withColumn("_copy", F.monotonically_increasing_id())  # copies of a row may be split
    spread = spread.repartitionByRange("group", key, "leaf", "_copy").sortWithinPartitions("group", key, "leaf", "_copy").drop("_copy")
    spread = materialise(spread.withColumn("_at", F.monotonically_increasing_id()))  # range in the upper 31 bits, place in the others
    spread = spread.withColumn("_range", F.shiftright("_at", 33))
    ranges = spread.groupBy("group", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("group").alias("_group"), F.col("_range").alias("_r"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("group")).alias("n"))
    out = spread.join(ranges, F.col("group").eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_group", "_r", "_first", "_before")


def _blocks(leaves: DataFrame, fanout: int, local: int, carried: list[str]) -> DataFrame:
    """A row a leaf: ``group, block, blocks, node`` (its block's root), its ``place`` there, ``leaf``, what is ``carried``, and its lower ``proof``."""
    size = fanout**local
    rows = leaves.select("group", (F.col("rank") / size).cast("long").alias("block"), "n", F.struct((F.col("rank") % size).cast("int").alias("place"), "leaf", *carried).alias("m"))
    out = rows.groupBy("group", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("m"), lambda a, b: a["place"] - b["place"]).alias("members"))
    out = settled(out, "members")
    out = out.withColumn("d0", F.transform("members", lambda m: m["leaf"]))
    for level in range(local):
        nodes = F.col(f"d{level}")
        parents = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), lambda i: _hashed(F.slice(nodes, i * fanout + 1, fanout)))
        out = settled(out, f"d{level}").withColumn(f"d{level + 1}", F.when(F.col("n") > fanout**level, parents).otherwise(nodes))
    out = settled(out, f"d{local}")

    def lower(m: Column) -> Column:
        steps = []
        for level in range(local):
            at = F.floor(m["place"] / fanout**level).cast("int")
            run = F.slice(F.col(f"d{level}"), F.floor(m["place"] / fanout ** (level + 1)).cast("int") * fanout + 1, fanout)
            steps.append(F.when(F.col("n") > fanout**level, F.array(_siblings(run, at % fanout))).otherwise(F.array().cast(_PROOF)))
        return m.withField("proof", F.concat(*steps).cast(_PROOF))

    blocks = F.floor((F.col("n") + size - 1) / size).cast("long").alias("blocks")
    out = out.select("group", "block", blocks, F.col(f"d{local}")[0].alias("node"), F.explode(F.transform("members", lower)).alias("m"))
    return out.select("group", "block", "blocks", "node", *(F.col(f"m.`{c}`") for c in ("place", "leaf", *carried, "proof")))


def _swap(blocks: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round: subtrees of ``span`` blocks, in aligned groups of ``fanout``, swap their roots; each block hashes the ancestor."""
    mine = F.floor(F.col("block") / span).cast("long")  # the subtree
    place = F.col("block") % span
    trees = F.floor((F.col("blocks") + span - 1) / span).cast("long")
    size = lambda t: F.least(F.lit(span).cast("long"), F.col("blocks") - t * span)
    first = F.floor(mine / fanout).cast("long") * fanout
    last = F.least(first + fanout - 1, trees - 1)
    none = F.array().cast("array<bigint>")
    # The last subtree can have fewer places than the others: its block at place p also sends to p + size, p + 2 size, ...
    to = lambda t: F.when(place < size(t), F.transform(F.sequence(place, size(t) - 1, size(mine)), lambda p: t * span + p)).otherwise(none)
    receivers = F.when(trees > 1, F.flatten(F.transform(F.sequence(first, last), to))).otherwise(F.array("block"))
    sent = blocks.select("group", "blocks", F.col("block").alias("sender"), mine.alias("tree"), "node", "proof", F.explode(receivers).alias("block"))
    own = F.col("sender") == F.col("block")
    got = sent.groupBy("group", "block").agg(
        F.first("blocks").alias("blocks"),
        F.array_sort(F.collect_list(F.struct("tree", "node"))).alias("run"),
        F.max(F.when(own, F.col("tree"))).alias("tree"),
        F.first(F.when(own, F.col("proof")), ignorenulls=True).alias("proof"),
        F.first(F.when(own, F.col("node")), ignorenulls=True).alias("node"),
    )
    got = settled(got, "run")
    nodes, going = F.transform("run", lambda r: r["node"]), F.floor((F.col("blocks") + span - 1) / span) > 1
    proof = F.when(going, F.concat("proof", F.array(_siblings(nodes, (F.col("tree") % fanout).cast("int"))))).otherwise(F.col("proof"))
    return got.select("group", "block", "blocks", F.when(going, _hashed(nodes)).otherwise(F.col("node")).alias("node"), proof.cast(_PROOF).alias("proof"))


def tree(leaves: DataFrame, key: str, fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """``leaves`` (``group, leaf``, ``key`` and more) with ``root``, the group's, and ``proof``: siblings (``left``, ``right``) of each level."""
    carried = [c for c in leaves.columns if c not in ("group", "leaf")]
    rows = materialise(_blocks(ranked(leaves, key), fanout, local, carried))
    most = rows.agg(F.max("blocks")).first()[0] or 0
    upper, span = rows.where("place = 0").select("group", "block", "blocks", "node", F.array().cast(_PROOF).alias("proof")), 1
    while span < most:
        upper, span = _swap(upper, span, fanout), span * fanout
    upper = upper.select(F.col("group").alias("_group"), F.col("block").alias("_block"), F.col("node").alias("root"), F.col("proof").alias("_upper"))
    out = rows.join(upper, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
    return out.select("group", "leaf", *carried, "root", F.concat("proof", "_upper").alias("proof"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """``id, group, leaf, subroot, root, proof`` for each row, and what ``docs`` has in columns named ``_carried``.

    ``proof`` leads from the leaf by way of its group's ``subroot`` to ``root``.
    """
    more = [c for c in docs.columns if c.startswith("_carried")]
    leaves = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), digest(*(F.col(c) for c in columns)).alias("leaf"), *more)
    rows = materialise(tree(materialise(leaves), "id", fanout, local).withColumnRenamed("root", "subroot"))
    groups = rows.groupBy("group").agg(F.first("subroot").alias("leaf")).select(F.lit(0).alias("group"), "leaf", F.col("group").alias("name"))
    top = tree(materialise(groups), "name", fanout, local).select(F.col("name").alias("_name"), "root", F.col("proof").alias("_top"))
    out = rows.join(top, F.col("group").eqNullSafe(F.col("_name")))
    return out.select("id", "group", "leaf", "subroot", "root", F.concat("proof", "_top").alias("proof"), *more)
