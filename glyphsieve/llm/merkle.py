"""A Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

Levels are DataFrames.  Rows are placed once: range partitions in the order of the tree, row numbers within each part
of a group, and the sizes of the parts before it, so that no group is ever sorted by one task.  A place divided by the
fanout is the place of the parent; the children of a parent are one sorted array, hashed into the next level.
Siblings come down by one join a level, from the root to the leaves: what lies above a run of children is kept once
for the run, so the tables shrink by the fanout from level to level and only the last join meets every row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

FANOUT = 16
#: What a null is hashed as.
ABSENT = "-"

_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def framed(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself, so no two rows read the same."""
    s = value.cast("string")
    return F.when(s.isNull(), ABSENT).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(*values: Column) -> Column:
    return digest(*map(framed, values))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings on the way, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def _placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (key, ...) with place, from 0 within each key in the given order, and n, the rows of the key.

    A key of any size is spread over the range partitions; only rows alike in key and order stay together, and which
    of those comes first makes no difference.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id())
    kept = scratch.write(spread, "placed")  # the parts are fixed from here on
    by_part = kept.groupBy("key", "part").agg(F.count("*").alias("here"))
    whole, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("key", "part", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    numbered = kept.withColumn("row", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)).cast("long") - 1)
    return numbered.join(before, ["key", "part"]).withColumn("place", F.col("row") + F.col("before")).drop("row", "before", "part")


@dataclass
class Tree:
    """runs[l]: key, place, n (of level l + 1) and kids, the sorted nodes of level l under each; roots: key, root."""

    runs: list[DataFrame]
    roots: DataFrame


def _up() -> Column:
    return F.floor(F.col("place") / FANOUT).cast("long")


def _tree(nodes: DataFrame, scratch: Scratch) -> Tree:
    """nodes: key, place, n, h.  Trees of different heights end at different levels; a lone node is a root as it is."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    runs, roots, level = [], nodes.filter("n = 1").select("key", F.col("h").alias("root")), nodes
    while most > 1:
        kids = level.filter("n > 1").groupBy("key", _up().alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("kids"), F.ceil(F.first("n") / FANOUT).cast("long").alias("n"))
        run = kids.select("key", F.col("up").alias("place"), "n", F.transform("kids", lambda k: k["h"]).alias("kids"))
        runs.append(scratch.write(run, f"level{len(runs)}"))
        level = runs[-1].select("key", "place", "n", digest(F.array_join("kids", "")).alias("h"))
        roots = roots.unionByName(level.filter("n = 1").select("key", F.col("h").alias("root")))
        most = -(-most // FANOUT)
    return Tree(runs, roots)


def _with_siblings(nodes: DataFrame, tree: Tree, above: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """nodes (key, place, n, ...) of a level with steps: the siblings left and right of each on the way up, past its
    tree's root on to what above (key, steps, ...) says of the whole tree, whose other columns come along."""
    alone = nodes.filter("n = 1").join(above, "key")
    if level == len(tree.runs):
        return alone
    over = _with_siblings(tree.runs[level], tree, above, scratch, level + 1).withColumnsRenamed({"place": "up", "kids": "beside"}).drop("n")
    over = scratch.write(over, f"above{level}")
    met = nodes.filter("n > 1").withColumn("up", _up()).join(over, ["key", "up"])
    at = (F.col("place") % FANOUT).cast("int")
    left, right = F.array_join(F.slice("beside", F.lit(1), at), ""), F.array_join(F.slice("beside", at + 2, F.lit(FANOUT)), "")
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    return alone.unionByName(met.withColumn("steps", F.concat(own, "steps")).drop("beside", "up"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, steps, and what carry computes from the row.

    A leaf hashes the fields; the leaves of a group are in ascending order of id; the groups' roots (subroots) are in
    ascending order of group, byte by byte, and make the last tree.  steps are the siblings on the way from the leaf
    to the root; fold(leaf, steps) gives the root again.

    Defined cases: a null field is hashed as "-", an empty one as "0:"; rows of a null group are a group of their own,
    which comes first; null ids come first; rows of equal id are ordered by leaf, so equal rows each have a place and
    a row; a group of one row has its leaf as subroot, a table of one group has its subroot as root; an empty table
    gives no rows.  Columns other than those named are not read, whatever their names.  A text is hashed within its
    row and moves no further.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    col = lambda c: F.col(f"`{c}`")
    key = F.when(col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), col(group_col).cast("string")))
    more = carry or {}
    rows = docs.select(col(id_col).alias("id"), key.alias("key"), leaf_of(*map(col, fields)).alias("leaf"), *[c.alias(name) for name, c in more.items()])
    rows = scratch.write(rows, "hashed")  # the texts are read here and not again
    leaves = scratch.write(_placed(rows, ["id", "leaf", *more], scratch), "leaves")
    scratch.drop(rows)
    trees = _tree(leaves.select("key", "place", "n", F.col("leaf").alias("h")), scratch)
    subroots = scratch.write(trees.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("subroot")), "subroots")
    tops = scratch.write(_placed(subroots, ["group"], scratch), "tops")
    top = _tree(tops.select("key", "place", "n", F.col("subroot").alias("h")), scratch)
    none = F.array().cast(_STEPS).alias("steps")
    above = _with_siblings(tops, top, top.roots.select("key", "root", none), scratch)
    above = scratch.write(above.select(F.col("group").alias("key"), "subroot", "root", "steps"), "above")
    return _with_siblings(leaves, trees, above, scratch).select("id", "leaf", "subroot", "root", "steps", *more)
