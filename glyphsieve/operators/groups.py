"""The stylometric measures of groups of texts taken together: all texts of a language, of a source, of a table.

Each measure is a sum over counts that merge in any order: tasks count what they read, the shuffle holds a row for each
distinct item of a task and group, and a hot group is spread over the items it has, never gathered by its key alone.  A
group without a word, its texts null or empty, still has its row.  Nulls among the groups' keys are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import phrases
from ..functions.arrowtext import give_back
from ..functions.arrowtext import pieces as text_pieces
from ..functions.numbers import round3
from ..functions.pairs import pair_counts, pieces
from . import stylometry as style


def _keys(by: list[str]) -> list[str]:
    """Names of the keys within, which no column of the caller's has."""
    return [f"__k{i}" for i in range(len(by))]


def _keyed(df: DataFrame, by: list[str], **more: Column) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, _keys(by))], *[c.alias(name) for name, c in more.items()])


def _named(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(_keys(by), by)))


def group_numbers(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(the group of each row by its first columns, numbered from 0; a row of each group)."""
    group = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):  # columns one after the other, so keys of any type and nulls are told apart
        value = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = pd.factorize(group * (int(value.max(initial=0)) + 1) + value)[0].astype(np.int64)
    return group, np.unique(group, return_index=True)[1]


def _entropy(counts: DataFrame, by: list[str], total: str, distinct: str) -> DataFrame:
    """(keys, item, n) -> keys, total, distinct, entropy_bits; a null item counts nothing and keeps its group."""
    n = F.when(F.col("item").isNotNull(), F.col("n")).otherwise(0).cast("long")
    weight = F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    sums = counts.groupBy(*_keys(by)).agg(F.sum(n).alias(total), F.count("item").alias(distinct), F.sum(weight).alias("__w"))
    bits = F.when(F.col(total) > 0, F.greatest(F.log2(F.col(total).cast("double")) - F.col("__w") / F.col(total), F.lit(0.0)))
    return sums.withColumn("entropy_bits", bits).drop("__w")


def _words(df: DataFrame, by: list[str], text: str) -> DataFrame:
    rows = _keyed(df, by, item=F.explode_outer(style.words(F.col(f"`{text}`"))))
    return rows.groupBy(*_keys(by), "item").agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, word, n: how often each lower-cased word occurs in a group; n at a null word is the texts without any."""
    return _named(_words(df, by, text).withColumnRenamed("item", "word"), by)


def word_entropy(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, words, distinct_words, entropy_bits, lexical_diversity (0 to 10) and its band, of all words of a group.

    entropy_bits is null, and lexical_diversity 0, without a word.
    """
    out = _entropy(_words(df, by, text), by, "words", "distinct_words")
    most = F.log2(F.col("words").cast("double"))
    out = out.withColumn("__x", F.when(F.col("words") > 1, F.least(F.col("entropy_bits") / most, F.lit(1.0)) * 10).when(F.col("words") == 1, 0.0))
    out = out.withColumn("lexical_diversity", F.coalesce(round3(F.col("__x")), F.lit(0.0)))
    return out.withColumn("band", F.when(F.col("words") > 0, style.band(F.col("lexical_diversity"), style.LEXICAL_BANDS, "varied")).otherwise("no_words")).drop("__x").transform(_named, by)


def _pairs(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(keys, item, n).  Batches are counted as arrays, so the rows made are the distinct pairs of a batch and not its
    characters; a null item of no count stands for each group."""
    plain = _keys(by)
    rows = _keyed(df, by, t=style.folded(F.col(f"`{text}`")))
    schema = T.StructType([*[T.StructField(p, rows.schema[p].dataType) for p in plain], T.StructField("item", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(len(plain)).to_pylist()]
            group, one = group_numbers(batch, len(plain))
            parts = [(np.arange(len(one)), np.full(len(one), -1), np.zeros(len(one), np.int64))]
            parts += [pair_counts(texts[i:j], group[i:j]) for i, j in pieces(np.fromiter(map(len, texts), np.int64, len(texts)))]
            who, pair, n = (np.concatenate(x) for x in zip(*parts))
            keys = [batch.column(i).take(pa.array(one[who])) for i in range(len(plain))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pair, pa.int64(), mask=pair < 0), pa.array(n)], names=schema.names)

    return rows.mapInArrow(run, schema).groupBy(*plain, "item").agg(F.sum("n").alias("n"))


def pair_counts_by(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, pair, n: counts of overlapping character pairs within the texts, lower-cased and with white space runs as one
    space; pair is first << 21 | second."""
    return _named(_pairs(df, by, text).filter("item IS NOT NULL").withColumnRenamed("item", "pair"), by)


def pair_entropy(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, pairs, distinct_pairs, entropy_bits, bigram_entropy (0 to 10) and its band, of all character pairs of a
    group's texts.  entropy_bits is null, and bigram_entropy 0, without a pair."""
    out = _entropy(_pairs(df, by, text), by, "pairs", "distinct_pairs")
    out = out.withColumn("__x", F.when(F.col("pairs") > 0, F.least(F.col("entropy_bits") / style.BIGRAM_BITS, F.lit(1.0)) * 10))
    out = out.withColumn("bigram_entropy", F.coalesce(round3(F.col("__x")), F.lit(0.0)))
    return out.withColumn("band", F.when(F.col("pairs") > 0, style.band(F.col("bigram_entropy"), style.BIGRAM_BANDS, "typical")).otherwise("too_short")).drop("__x").transform(_named, by)


_EXACT = "decimal(38,0)"
#: Bytes of text whose phrases are held at once.
PHRASE_BYTES = 4 << 20


def sentence_moments(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, n, s1, s2: sentences, and the sums of their word counts and of the squares of these.  Whole numbers, so the
    moments of parts add up to those of the whole exactly, in any order and at any later time."""
    lengths = F.transform(style.sentences(F.col(f"`{text}`")), lambda s: F.regexp_count(s, F.lit(style.WORD)).cast("long"))
    rows = _keyed(df, by, __l=F.coalesce(lengths, F.array().cast("array<bigint>")))
    total = lambda f: F.aggregate("__l", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return rows.groupBy(*_keys(by)).agg(F.sum(F.size("__l").cast("long")).alias("n"), F.sum(total(lambda x: x).cast(_EXACT)).alias("s1"), F.sum(total(lambda x: x * x).cast(_EXACT)).alias("s2")).transform(_named, by)


def merge_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """Moments of parts, from any number of runs, added up by group; by may be fewer keys than the parts have."""
    return moments.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])


def variation(moments: DataFrame) -> DataFrame:
    """Moments with sentences, mean_words, m2 (the sum of squared distances from the mean), variation (stddev_pop /
    mean), sentence_variance (0 to 10) and its band.  Fewer than three sentences, or none with a word, are neutral."""
    n, s1, s2 = (F.col(c).cast("double") for c in ("n", "s1", "s2"))
    # n * s2 - s1 * s1 is exact in whole numbers up to 10^38, where the difference of two doubles would lose its digits
    apart = (F.col("n").cast("decimal(19,0)") * F.col("s2").cast("decimal(19,0)") - F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")).cast("double")
    out = moments.withColumns({"mean_words": F.when(n > 0, s1 / n), "m2": F.when(n > 0, apart / n)})
    known = (F.col("n") >= style.LEAST_SENTENCES) & (s1 > 0)
    out = out.withColumn("variation", F.when(known, F.sqrt(apart) / s1))
    out = out.withColumn("__x", F.when(known, F.least(F.col("variation") / style.VARIATION_SCALE, F.lit(1.0)) * 10))
    out = out.withColumn("sentence_variance", F.coalesce(round3(F.col("__x")), F.lit(style.NEUTRAL)))
    out = out.withColumn("band", F.when(known, style.band(F.col("sentence_variance"), style.VARIANCE_BANDS, "varied")).otherwise("too_few_sentences"))
    return out.drop("s1", "s2", "__x").withColumnRenamed("n", "sentences")


#: Bytes of packed phrases that are sorted at once, if no bucket of a group is larger.
HELD_BYTES = 8 << 20
#: A bucket of phrases holds what so many bytes of the table have of them.
BUCKET_BYTES = 32 << 20


def repetition(texts: DataFrame, by: list[str], buckets: int, size: int = 3) -> DataFrame:
    """(by, t: lower-cased, ...) -> by, phrases, distinct_phrases, exact but for 96-bit keys of the phrases.

    Pieces of texts are turned into keys, each once a piece and group, and packed by group and bucket of the keys.  A
    group's phrases are spread over all buckets, so a hot group is that many tasks' work, and what meets by group alone
    is a count for each bucket.
    """
    rows = texts.select(*by, "t")
    keys = [T.StructField(k, rows.schema[k].dataType) for k in by]
    sent = T.StructType([*keys, T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_pieces(batches, "t", PHRASE_BYTES):
            group, one = group_numbers(part, len(by))
            text, a, b = phrases.phrase_keys(data, off, size)
            owner = group[text]
            total = np.bincount(owner, minlength=len(one))
            slot = owner * buckets + (a >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(slot, kind="stable")
            slot, a, b = slot[order], a[order], b[order]
            edges = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
            out = [(g, 0, int(n), b"") for g, n in enumerate(total)]  # a row for each group, with or without phrases
            for i, j in zip(edges.tolist(), np.append(edges[1:], len(slot)).tolist()):
                some = phrases.distinct(a[i:j], b[i:j])
                out.append((int(slot[i]) // buckets, int(slot[i]) % buckets, 0, phrases.pack(a[i:j][some], b[i:j][some])))
            who, bucket, n, packed = zip(*out)
            at = pa.array(one[list(who)])
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(by))], pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=sent.names)

    met = T.StructType([*keys, T.StructField("phrases", T.LongType()), T.StructField("distinct_phrases", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of group and bucket: all but the last, which may go on, are settled as soon as they fill up."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > HELD_BYTES:
                table = pa.Table.from_batches(held)
                open_ = int(_starts(table, len(by) + 1)[-1])
                held = table.slice(open_).combine_chunks().to_batches()
                if open_:
                    yield settled(table.slice(0, open_))
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield settled(table)
        give_back()

    def settled(table: pa.Table) -> pa.RecordBatch:
        first = _starts(table, len(by) + 1)
        packed = [phrases.unpack(x.as_py()) for x in table["packed"]]
        owner = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows))), [len(a) for a, _ in packed])
        a, b = (np.concatenate(x) for x in zip(*packed))
        n = np.bincount(owner[phrases.distinct(a, b, owner)], minlength=len(first))
        keys = [table[k].combine_chunks().take(pa.array(first)) for k in by]
        keys = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.add.reduceat(table["n"].to_numpy(), first)), pa.array(n)], names=met.names)

    parts = rows.mapInArrow(run, sent)
    parts = parts.repartition(*by, "bucket").sortWithinPartitions(*by, "bucket").mapInArrow(counted, met)
    return parts.groupBy(*by).agg(F.sum("phrases").alias("phrases"), F.sum("distinct_phrases").alias("distinct_phrases"))


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """The rows at which the first columns change."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        value = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        code = (pa.concat_arrays([c.indices for c in value.chunks]) if isinstance(value, pa.ChunkedArray) else value.indices).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def phrase_buckets(df: DataFrame) -> int:
    """By the size of the table as its source tells it, which costs no pass; a source that can't tell gets four for
    every shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(1 << 24, size // BUCKET_BYTES))


def scored_repetition(counts: DataFrame, size: int = 3) -> DataFrame:
    """counts with phrase_repetition (0 to 10, distinct phrases in all) and its band; too few phrases are neutral."""
    enough = F.col("phrases") > style.LEAST_REPETITION_WORDS - size
    out = counts.withColumn("__x", F.when(enough, F.col("distinct_phrases") / F.col("phrases") * 10))
    out = out.withColumn("phrase_repetition", F.coalesce(round3(F.col("__x")), F.lit(style.NEUTRAL)))
    return out.withColumn("band", F.when(enough, style.band(F.col("phrase_repetition"), style.REPETITION_BANDS, "typical")).otherwise("too_few_words")).drop("__x")


def phrase_repetition(df: DataFrame, by: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """by, phrases, distinct_phrases, phrase_repetition and its band: exact counts of the size-word phrases of all texts
    of a group.  Phrases don't cross from one text to the next; ordered.phrase_repetition has those that do."""
    rows = _keyed(df, by, t=F.lower(F.col(f"`{text}`")))
    return scored_repetition(repetition(rows, _keys(by), phrase_buckets(df), size), size).transform(_named, by)
