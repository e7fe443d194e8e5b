"""Windows over words that run on from row to row: the turns of a conversation, the lines of a file.

Rows of a sequence are put in order over range partitions, so a sequence of any length is many tasks' work.  What is
carried between rows are border words only, size - 1 at either end of a row; texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import groups
from . import stylometry as style


def following(heads: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """heads (by, order, h: a row's first words, count at most, none empty, ...) with after: the count words that follow
    the row in its sequence, from as many rows as it takes.

    Words come from the rows behind within a part, and, for the last rows of a part, from the first rows of the parts
    behind it; a row that has any gives a word at least, so count rows do.  Ties in the order are broken by the other
    columns.
    """
    spark = heads.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, *[c for c in heads.columns if c not in (*by, *order)]]
    spread = heads.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id())
    rows = Scratch(spark, "ordered").write(spread, "spread")  # the parts are fixed from here on
    inner = Window.partitionBy("__part", *by).orderBy(*order)
    rows = rows.withColumns({"__row": F.row_number().over(inner), "__near": F.flatten(F.array(*[F.coalesce(F.lead("h", i).over(inner), F.array().cast("array<string>")) for i in range(1, count + 1)]))})
    first = rows.filter(F.col("__row") <= count).groupBy("__part", *by).agg(F.sort_array(F.collect_list(F.struct("__row", "h"))).alias("x"))
    first = first.select("__part", *by, F.slice(F.flatten(F.col("x.h")), F.lit(1), F.lit(count)).alias("x"))
    outer = Window.partitionBy(*by).orderBy("__part")  # a row for each part that a sequence reaches into
    ahead = F.flatten(F.array(*[F.coalesce(F.lead("x", i).over(outer), F.array().cast("array<string>")) for i in range(1, count + 1)]))
    first = first.select("__part", *by, F.slice(ahead, F.lit(1), F.lit(count)).alias("__far"))
    same = F.col("a.__part") == F.col("b.__part")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = rows.alias("a").join(first.filter(F.size("__far") > 0).alias("b"), same, "left")
    after = F.slice(F.concat("a.__near", F.coalesce("b.__far", F.array().cast("array<string>"))), F.lit(1), F.lit(count)).alias("after")
    return met.select(*[F.col(f"a.`{c}`") for c in heads.columns], after)


def crossing(tail: Column, after: Column, size: int) -> Column:
    """The phrases that start in the last size - 1 words of a row and end in the words after it."""
    both = F.concat(tail, after)
    starts = F.least(F.size(tail), F.size(both) - (size - 1))
    return F.transform(F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(both, i, F.lit(size)))


def phrase_repetition(df: DataFrame, by: list[str], order: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """by, words, phrases, crossing_phrases, distinct_phrases, phrase_repetition (0 to 10) and its band, for the rows of
    a sequence read as one text, its words running on from row to row.

    Defined cases: null and empty texts and those without a word add nothing, and words run on across them; a sequence
    without a word has a row; nulls among the keys are a sequence of their own; null orders come first; rows of equal
    order are put in the order of their first words, and if these are equal too, of their last; a one-word phrase
    (size 1) crosses nothing.
    """
    keys, places = [f"k{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    col = lambda c: F.col(f"`{c}`")
    rows = df.select(*[col(c).alias(k) for c, k in zip(by, keys)], *[col(c).alias(o) for c, o in zip(order, places)], style.words(col(text)).alias("w"), F.lower(col(text)).alias("t"))
    counts = rows.groupBy(*keys).agg(F.sum(F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0)).cast("long")).alias("words"))
    texts = rows.select(*keys, "t", F.lit(0).cast("long").alias("x"))
    if size > 1:
        border = rows.filter(F.size("w") > 0).select(*keys, *places, F.slice("w", F.lit(1), F.lit(size - 1)).alias("h"), F.slice("w", F.greatest(F.size("w") - (size - 2), F.lit(1)), F.lit(size - 1)).alias("e"))
        met = following(border, keys, [*places], size - 1)
        over = met.select(*keys, F.explode(crossing(F.col("e"), F.col("after"), size)).alias("p")).select(*keys, F.array_join("p", " ").alias("t"), F.lit(1).cast("long").alias("x"))
        over = Scratch(df.sparkSession, "crossing").write(over, "over")
        texts = texts.unionByName(over)
        counts = counts.unionByName(over.groupBy(*keys).agg(F.lit(0).cast("long").alias("words"), F.sum("x").alias("x")), allowMissingColumns=True)
        counted = counts.groupBy(*keys).agg(F.sum("words").alias("words"), F.coalesce(F.sum("x"), F.lit(0)).alias("crossing_phrases"))
    else:
        counted = counts.withColumn("crossing_phrases", F.lit(0).cast("long"))
    sums = groups.repetition(texts, keys, groups.phrase_buckets(df), size)
    same = None
    for k in keys:
        one = F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}"))
        same = one if same is None else same & one
    met = groups.scored_repetition(sums, size).alias("s").join(counted.alias("c"), same)
    return met.select(*[F.col(f"s.{k}").alias(c) for k, c in zip(keys, by)], "words", "phrases", "crossing_phrases", "distinct_phrases", "phrase_repetition", "band")
