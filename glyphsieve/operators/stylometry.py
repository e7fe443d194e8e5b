"""Four heuristic signals of how varied a text is, a weighted composite, and how far it can be trusted.

Higher means more varied.  A weak exploratory reading, never evidence of who or what wrote a text.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codepoints as cp
from ..functions import phrases
from ..functions.arrowtext import byte_sizes, flat, give_back, runs, word_hashes
from ..functions.numbers import round3
from ..functions.pairs import pair_counts

# Words, and the weights, scales and bands of the signals.
WORD = "[A-Za-z0-9']+"
LEXICAL_WEIGHT = 1.2
BIGRAM_BITS, BIGRAM_SHORT_WEIGHT = 4.2, 0.8
VARIATION_SCALE = 0.5
NEUTRAL, NEUTRAL_WEIGHT = 5.0, 0.6
LEAST_SENTENCES, LEAST_REPETITION_WORDS = 3, 10
LEXICAL_BANDS = ((4.0, "concentrated"), (7.5, "moderate"))
BIGRAM_BANDS = ((5.0, "repetitive"),)
VARIANCE_BANDS = ((4.0, "uniform"),)
REPETITION_BANDS = ((6.0, "repetitive"),)
CONFIDENCE = ((60, "low"), (200, "moderate"), (600, "elevated"))
SUMMARY = ((7.0, "varied"), (4.5, "moderately_uniform"))

DISCLAIMER = "Hidden characters are found exactly; the stylometric score is a heuristic and proves nothing about authorship."

SIGNAL = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("band", T.StringType())])


def words(text: Column) -> Column:
    """The words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words of the text as it is; only U+0130 and U+212A make this differ from words()."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sentences(text: Column) -> Column:
    bare = F.left(text, F.lit(1)).rlike(cp.NOT_WS) & F.right(text, F.lit(1)).rlike(cp.NOT_WS)
    trimmed = F.when(bare, text).otherwise(F.regexp_replace(text, f"^{cp.WS}+|{cp.WS}+$", ""))
    return F.filter(F.split(trimmed, f"(?<=[.!?]){cp.WS}+", -1), lambda s: s.rlike(cp.NOT_WS))


def folded(text: Column) -> Column:
    """Lower-cased, with each run of white space as one space."""
    # a single space stays as it is, and is not replaced by itself
    return F.regexp_replace(F.lower(text), f"[{cp.WS}&&[^ ]]{cp.WS}*| {cp.WS}+", " ")


_COUNTED = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("repeats", T.DoubleType()), T.StructField("triples", T.IntegerType()), T.StructField("bits", T.DoubleType())])
#: Bytes of text counted at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def _weights(counts: np.ndarray) -> np.ndarray:
    return counts * np.log2(counts)


def counted(texts: pa.Array) -> pa.Array:
    """Of each folded text: its words, the sum of c * log2(c) over the counts c of equal words, its distinct runs of
    three words, and the entropy of its character pairs in bits, null without a pair.  Words are told by 64 bits within
    a text, runs of three by 96."""
    data, off = flat(texts)
    rows = len(texts)
    starts, ends, first = phrases.word_ranges(data, off)
    n = np.diff(first)
    owner, h = np.repeat(np.arange(rows), n), word_hashes(data, starts, ends)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    repeats = np.bincount(owner[new], _weights(np.diff(np.append(new, len(h)))), rows)
    who, a, b = phrases.phrase_keys(data, off, 3)
    triples = np.bincount(who[phrases.distinct(a, b, who)], minlength=rows) if len(who) else np.zeros(rows, np.int64)
    row, _, c = pair_counts(["" if t is None else t for t in texts.to_pylist()], np.arange(rows))
    total = np.bincount(row, c, rows)
    some = np.where(total > 0, total, 1)
    bits = np.log2(some) - np.bincount(row, _weights(c), rows) / some
    fields = [pa.array(n, pa.int32()), pa.array(repeats, pa.float64()), pa.array(triples, pa.int32()), pa.array(bits, pa.float64(), mask=total == 0)]
    return pa.StructArray.from_arrays(fields, _COUNTED.names)


def _pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for i, j in runs(byte_sizes(texts), PIECE_BYTES):
            yield counted(texts[i:j])
    give_back()


@F.arrow_udf(_COUNTED)
def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _pieces(batches)


def bigram_bits(text: Column) -> Column:
    """Shannon entropy of overlapping character pairs, lower-cased and with white space runs as one space; null
    for texts of fewer than two characters."""
    return _counted(folded(text))["bits"]


def band(value: Column, bands, last: str) -> Column:
    out = F.lit(last)
    for edge, name in reversed(bands):
        out = F.when(value < edge, name).otherwise(out)
    return out


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the raw measures: __n words, __s sentences, and what the signals need of them."""
    t = F.col(text)
    out = df.withColumn("__l", F.transform(sentences(t), lambda s: F.regexp_count(s, F.lit(WORD)).cast("double")))
    out = out.withColumns({"__s": F.size("__l"), "__c": _counted(folded(t))})
    mean = F.aggregate("__l", F.lit(0.0), lambda a, x: a + x) / F.col("__s")
    out = out.withColumns({"__n": F.when(t.isNotNull(), F.col("__c.n")), "__mean": F.when(F.col("__s") >= LEAST_SENTENCES, mean)})
    spread = F.aggregate("__l", F.lit(0.0), lambda a, x: a + (x - F.col("__mean")) * (x - F.col("__mean"))) / F.col("__s")
    return out.withColumns(
        {
            "__repeats": F.when(F.col("__n") > 1, F.col("__c.repeats")),
            "__spread": F.when(F.col("__mean") > 0, spread),
            "__triples": F.when(F.col("__n") >= LEAST_REPETITION_WORDS, F.col("__c.triples")),
            "__bits": F.col("__c.bits"),
        }
    )


SIGNALS = ("lexical_diversity", "character_bigram_entropy", "sentence_length_variance", "phrase_repetition")


def signals(df: DataFrame) -> DataFrame:
    """measure()'s columns plus value, weight and band of each signal as __v0, __w0, __b0 and so on.

    Raw values, rounded values and bands are columns of three steps: rounding and bands name their argument many
    times, and a column is computed once.
    """
    n, log_n = F.col("__n"), F.log2(F.col("__n").cast("double"))
    out = df.withColumns(
        {
            "__x0": F.when(n > 1, F.greatest(F.least((log_n - F.col("__repeats") / n) / log_n, F.lit(1.0)), F.lit(0.0)) * 10),
            "__x1": F.when(F.col("__bits").isNotNull(), F.least(F.col("__bits") / BIGRAM_BITS, F.lit(1.0)) * 10),
            "__x2": F.when(F.col("__spread").isNotNull(), F.least(F.sqrt("__spread") / F.col("__mean") / VARIATION_SCALE, F.lit(1.0)) * 10),
            "__x3": F.col("__triples") / (n - 2) * 10,
        }
    )
    out = out.withColumn("__x0", F.when(n > 0, F.coalesce("__x0", F.lit(0.0))))
    blank, short_weight = (0.0, 0.0, NEUTRAL, NEUTRAL), (1.0, BIGRAM_SHORT_WEIGHT, NEUTRAL_WEIGHT, NEUTRAL_WEIGHT)
    full_weight = (LEXICAL_WEIGHT, 1.0, 1.0, 1.0)
    out = out.withColumns({f"__v{i}": F.coalesce(round3(F.col(f"__x{i}")), F.lit(blank[i])) for i in range(4)})
    bands = ((LEXICAL_BANDS, "varied", "no_words"), (BIGRAM_BANDS, "typical", "too_short"), (VARIANCE_BANDS, "varied", "too_few_sentences"), (REPETITION_BANDS, "typical", "too_few_words"))
    known = [F.col(f"__x{i}").isNotNull() for i in range(4)]
    out = out.withColumns({f"__w{i}": F.when(known[i], full_weight[i]).otherwise(short_weight[i]) for i in range(4)})
    return out.withColumns({f"__b{i}": F.when(known[i], band(F.col(f"__v{i}"), b, top)).otherwise(none) for i, (b, top, none) in enumerate(bands)})


def stylometry(df: DataFrame, text: str = "text", raw_bits: bool = False) -> DataFrame:
    """df with signals (an array of four), composite_score, confidence and summary; all null for a null text.

    With raw_bits also bigram_bits, as the bigram signal reaches its ceiling for most prose.
    """
    known = F.col(text).isNotNull()
    out = signals(measure(df, text))
    total = sum((F.col(f"__v{i}") * F.col(f"__w{i}") for i in range(1, 4)), F.col("__v0") * F.col("__w0"))
    weight = sum((F.col(f"__w{i}") for i in range(1, 4)), F.col("__w0"))
    out = out.withColumn("__raw", F.when(known, F.greatest(F.least(total / weight, F.lit(10.0)), F.lit(0.0))))
    low = (F.col("__n") < CONFIDENCE[0][0]) | (F.col("__s") < LEAST_SENTENCES)
    out = out.withColumn("composite_score", round3(F.col("__raw")))
    out = out.withColumn("confidence", F.when(known, F.when(low, "low").otherwise(band(F.col("__n"), CONFIDENCE, "high"))))
    summary = F.when(F.col("confidence") == "low", "short_sample").when(F.col("composite_score") >= SUMMARY[0][0], SUMMARY[0][1]).when(F.col("composite_score") >= SUMMARY[1][0], SUMMARY[1][1])
    found = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"__v{i}").alias("value"), F.col(f"__w{i}").alias("weight"), F.col(f"__b{i}").alias("band")) for i, k in enumerate(SIGNALS)])
    out = out.withColumns({"signals": F.when(known, found), "summary": F.when(known, summary.otherwise("notably_uniform"))})
    extra = [F.col("__bits").alias("bigram_bits")] if raw_bits else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "signals", "composite_score", "confidence", "summary", *extra)
