"""Exact detection of hidden and deceptive code points.  Positions count code points from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codepoints as cp

CONTEXT = 12
#: Rows with more findings than this are walked character by character, which is linear however dense they are.
DENSE = 64

FINDING = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("codepoint", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("context_before", T.StringType()),
        T.StructField("context_after", T.StringType()),
    ]
)


def has_hidden(text: Column) -> Column:
    return text.rlike(cp.QUICK_FLAGGED)


def hidden_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(cp.QUICK_FLAGGED)).cast("long")


def category_count(text: Column, category: str) -> Column:
    return F.regexp_count(text, F.lit(cp.quick_class(category))).cast("long")


def hidden_characters(text: Column) -> Column:
    """The flagged characters in order."""
    return F.regexp_extract_all(text, F.lit(f"({cp.QUICK_FLAGGED})"), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: inside a lambda a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _finding(position: Column, char: Column, before: Column, after: Column) -> Column:
    def at(place: Column) -> Column:
        return F.struct(
            position.cast("long").alias("position"),
            cp.codepoint_of(char).alias("codepoint"),
            cp.name_at(place).alias("name"),
            cp.category_at(place).alias("category"),
            before.alias("context_before"),
            after.alias("context_after"),
        )

    return _let(cp.place_of(char), at)


#: Position, character, text before and after, to what is kept of a finding.
Make = Callable[[Column, Column, Column, Column], Column]


def _sparse(text: Column, make: Make = _finding) -> Column:
    """From the stretches between findings: their lengths, added up once, place each finding, and their ends, woven with
    the flagged characters, hold its context, so no finding looks at the text from its beginning again."""
    none = F.array().cast("array<int>")
    add = lambda a, n: F.concat(a, F.array(F.when(F.size(a) > 0, F.get(a, F.size(a) - 1) + 1 + n).otherwise(n)))

    def placed(between: Column, chars: Column) -> Column:
        def woven(end: Callable[[Column, Column], Column]) -> Column:
            return F.flatten(F.zip_with(between, chars, lambda s, c: F.array(end(s, F.lit(CONTEXT)), F.coalesce(c, F.lit("")))))

        def at(places: Column, befores: Column, afters: Column) -> Column:
            # finding i is item 2 * i + 2 of the woven ones; the CONTEXT findings and stretches beside it reach far enough
            first = lambda i: F.greatest(2 * i + 1 - 2 * CONTEXT, F.lit(1))
            before = lambda i: F.right(F.array_join(F.slice(befores, first(i), 2 * i + 2 - first(i)), ""), F.lit(CONTEXT))
            after = lambda i: F.left(F.array_join(F.slice(afters, 2 * i + 3, F.lit(2 * CONTEXT + 1)), ""), F.lit(CONTEXT))
            return F.transform(chars, lambda c, i: make(F.get(places, i), c, before(i), after(i)))

        places = F.aggregate(F.transform(between, F.length), none, add)
        return _let(places, lambda p: _let(woven(F.right), lambda b: _let(woven(F.left), lambda a: at(p, b, a))))

    return _let(F.split(text, cp.QUICK_FLAGGED, -1), lambda between: _let(hidden_characters(text), lambda chars: placed(between, chars)))


def _dense(text: Column, make: Make = _finding) -> Column:
    def walked(chars: Column) -> Column:
        def at(i: Column) -> Column:
            before = F.array_join(F.slice(chars, F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT))), "")
            after = F.array_join(F.slice(chars, i + 2, F.lit(CONTEXT)), "")
            return make(i, F.get(chars, i), before, after)

        # printable ASCII is told by two comparisons, without a regular expression
        flagged = lambda c: ((c < " ") | (c > "~")) & c.rlike(cp.QUICK_FLAGGED)
        places = F.filter(F.transform(chars, lambda c, i: F.when(flagged(c), i)), lambda i: i.isNotNull())
        return F.transform(places, at)

    return _let(F.split(text, ""), walked)


def findings(text: Column) -> Column:
    """All findings in order of position; an empty array without any, null for a null text."""
    none = F.array().cast(T.ArrayType(FINDING))
    count = F.regexp_count(text, F.lit(cp.QUICK_FLAGGED))
    return F.when(text.isNull(), F.lit(None)).when(count == 0, none).when(count <= DENSE, _sparse(text)).otherwise(_dense(text))


def scan(df: DataFrame, text: str = "text", into: str = "findings") -> DataFrame:
    """df with the findings of a column."""
    return df.withColumn(into, findings(F.col(text)))


def ledger(df: DataFrame, keys: list[str], text: str = "text", context: bool = True) -> DataFrame:
    """One row per finding: the keys and the six fields, or the first four without context.  Texts without findings are
    filtered out first.  Names and categories are looked up once findings are rows, so only if they are asked for."""
    ends = ("context_before", "context_after") if context else ()

    def make(position: Column, char: Column, before: Column, after: Column) -> Column:
        return F.struct(position.cast("long").alias("position"), char.alias("__c"), *[c.alias(k) for c, k in zip((before, after), ends)])

    t = F.col("__t")
    hits = df.select(*keys, F.col(text).alias("__t")).filter(has_hidden(t))
    hits = hits.withColumn("__n", F.regexp_count(t, F.lit(cp.QUICK_FLAGGED)))
    rows = hits.select(*keys, F.inline(F.when(F.col("__n") <= DENSE, _sparse(t, make)).otherwise(_dense(t, make))))
    place, char = cp.place_of(F.col("__c")), F.col("__c")
    return rows.select(*keys, "position", cp.codepoint_of(char).alias("codepoint"), cp.name_at(place).alias("name"), cp.category_at(place).alias("category"), *ends)


def count_by_category(text: Column) -> Column:
    """Map from category to count, categories without a finding left out; null for a null text."""
    return counts_map(text, tuple(cp.CATEGORIES))


def counts_map(text: Column, categories: tuple[str, ...]) -> Column:
    """From one pass over the text: the flagged characters are taken out and counted by category."""
    empty = F.create_map().cast("map<string,bigint>")
    if not categories:
        return F.when(text.isNotNull(), empty)
    keys = F.array(*map(F.lit, categories))
    hits = F.regexp_extract_all(text, F.lit(f"({cp.quick_class(*categories)})"), F.lit(0))
    count = lambda kinds: F.transform(keys, lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long"))
    full = _let(F.transform(hits, cp.category_of), lambda kinds: F.map_from_arrays(keys, count(kinds)))
    found = text.rlike(cp.quick_class(*categories))
    return F.when(found, F.map_filter(full, lambda _, n: n > 0)).when(text.isNotNull(), empty)


def category_totals(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Totals of each category over a corpus, long form: by, category, n.  Texts are counted where they lie, so
    the shuffle holds at most a row per group, flagged character and task."""
    hits = df.select(*by, F.col(text).alias("__t")).filter(has_hidden(F.col("__t"))).select(*by, F.explode(hidden_characters(F.col("__t"))).alias("__c"))
    by_character = hits.groupBy(*by, "__c").agg(F.count("*").alias("__n"))  # 538 rows a group at most
    return by_character.groupBy(*by, cp.category_of(F.col("__c")).alias("category")).agg(F.sum("__n").alias("n"))


def inspection(text: Column) -> Column:
    """The text with every flagged character replaced by its code point in white brackets."""
    chars = F.transform(hidden_characters(text), lambda c: F.concat(F.lit("⟦"), cp.codepoint_of(c), F.lit("⟧")))
    parts = F.split(text, cp.QUICK_FLAGGED, -1)
    shown = F.array_join(F.flatten(F.zip_with(parts, chars, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    return F.when(has_hidden(text), shown).otherwise(text)


#: A dimension of up to so many rows is sent to every task; a larger one is joined by its key.
BROADCAST_ROWS = 1 << 16


def described(found: DataFrame, dimension: DataFrame, key: str = "codepoint") -> DataFrame:
    """Findings with the columns of a dimension by code point; a code point that it lacks has nulls.

    The dimension is counted first, up to BROADCAST_ROWS.  Beyond that, both sides are shuffled by the key, and Spark
    splits the partitions of code points that make up much of the findings.  Of rows of equal key the least counts, so
    no finding is doubled; a null key describes nothing.
    """
    told = [c for c in dimension.columns if c != key]
    if clash := set(told) & set(found.columns):
        raise ValueError(f"both tables have {', '.join(sorted(clash))}")
    rows = dimension.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*told)).alias("__d"))
    if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return found.join(rows, key, "left").select(*found.columns, *[F.col(f"__d.`{c}`").alias(c) for c in told])
