"""Registered queries over groups, sequences and streams of rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..functions.numbers import round3_sql
from ..operators import admission, groups, ordered, purify, replay, scan
from ..operators import stylometry as style
from ..sources.counters import Counters
from ..sources.scratch import Scratch
from ..streaming import admission as admission_stream
from ..streaming import batches, rollup
from ..streaming import files as file_stream
from ..streaming import rows as streaming
from . import samples
from .queries import _CATEGORY_SQL, _CHARS_SQL, _FLAGGED_SQL, _INJECTED_ONLY, _WHOLE, _WORD_SQL, _WS, ORACLE_SQL, QUERIES, _band_sql, _documents, _injected, _injected_sql, _load, query

__all__ = ["ORACLE_SQL", "QUERIES"]

_BY = ["lang", "source"]
_GROUPS_SQL = "g AS (SELECT DISTINCT lang, source FROM documents)"
_SAME = "x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source"


# -- groups ---------------------------------------------------------------------------------------------------


def _bits_sql(items: str) -> str:
    return f"""c AS (SELECT lang, source, x, count(*) AS c FROM ({items}) GROUP BY ALL),
        x AS (SELECT lang, source, sum(c)::BIGINT AS n, count(*) AS d, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM c GROUP BY ALL), {_GROUPS_SQL}"""


@query(
    "group_word_entropy",
    f"""WITH {_bits_sql(f"SELECT lang, source, unnest(regexp_extract_all(lower(text), '{_WORD_SQL}')) AS x FROM documents")},
    v AS (SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(d, 0) AS d, bits, CASE WHEN n > 1 THEN least(bits / log2(n), 1) * 10 ELSE 0.0::DOUBLE END AS v FROM g LEFT JOIN x ON {_SAME}),
    r AS (SELECT *, {round3_sql("v")} AS diversity FROM v)
    SELECT lang, source, n AS words, d AS distinct_words, round(bits, 6) AS entropy_bits, diversity AS lexical_diversity, CASE WHEN n = 0 THEN 'no_words' ELSE {_band_sql("diversity", style.LEXICAL_BANDS, "varied")} END AS band FROM r""",
)
def group_word_entropy(spark, sf_dir):
    return groups.word_entropy(_documents(spark, sf_dir), _BY).withColumn("entropy_bits", F.round("entropy_bits", 6))


@query(
    "group_pair_entropy",
    f"""WITH k AS (SELECT lang, source, string_split(regexp_replace(lower(text), '{_WS}+', ' ', 'g'), '') AS cs FROM documents),
    {_bits_sql("SELECT lang, source, unnest(list_zip(cs[1:len(cs) - 1], cs[2:len(cs)])) AS x FROM k WHERE len(cs) > 1")},
    v AS (SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(d, 0) AS d, bits, least(coalesce(bits, 0) / {style.BIGRAM_BITS}::DOUBLE, 1) * 10 AS v FROM g LEFT JOIN x ON {_SAME}),
    r AS (SELECT *, {round3_sql("v")} AS entropy FROM v)
    SELECT lang, source, n AS pairs, d AS distinct_pairs, round(bits, 6) AS entropy_bits, entropy AS bigram_entropy, CASE WHEN n = 0 THEN 'too_short' ELSE {_band_sql("entropy", style.BIGRAM_BANDS, "typical")} END AS band FROM r""",
)
def group_pair_entropy(spark, sf_dir):
    return groups.pair_entropy(_documents(spark, sf_dir), _BY).withColumn("entropy_bits", F.round("entropy_bits", 6))


_SENTENCES_SQL = f"""list_transform(list_filter(string_split(regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '([.!?]){_WS}+', '\\1' || chr(57344), 'g'), chr(57344)),
    lambda x: regexp_matches(x, '{cp.NOT_WS}')), lambda x: len(regexp_extract_all(x, '{_WORD_SQL}'))::DOUBLE)"""


@query(
    "group_sentence_variation",
    f"""WITH l AS (SELECT source, unnest({_SENTENCES_SQL}) AS l FROM documents), g AS (SELECT DISTINCT source FROM documents),
    x AS (SELECT source, count(*) AS n, sum(l) AS s1, count(*) * sum(l * l) - sum(l) * sum(l) AS apart FROM l GROUP BY ALL),
    v AS (SELECT g.source, coalesce(n, 0) AS n, s1 / n AS mean, apart / n AS m2, CASE WHEN n >= {style.LEAST_SENTENCES} AND s1 > 0 THEN sqrt(apart) / s1 END AS variation FROM g LEFT JOIN x ON x.source IS NOT DISTINCT FROM g.source),
    w AS (SELECT *, least(variation / {style.VARIATION_SCALE}::DOUBLE, 1) * 10 AS v FROM v), r AS (SELECT *, CASE WHEN v IS NULL THEN {style.NEUTRAL}::DOUBLE ELSE {round3_sql("v")} END AS variance FROM w)
    SELECT source, n AS sentences, round(mean, 6) AS mean_words, round(m2, 3) AS m2, round(variation, 6) AS variation, variance AS sentence_variance, CASE WHEN v IS NULL THEN 'too_few_sentences' ELSE {_band_sql("variance", style.VARIANCE_BANDS, "varied")} END AS band FROM r""",
)
def group_sentence_variation(spark, sf_dir):
    """By source, merged from the moments of each language of a source."""
    parts = groups.sentence_moments(_documents(spark, sf_dir), _BY)
    out = groups.variation(groups.merge_moments(parts, ["source"]))
    return out.withColumns({"mean_words": F.round("mean_words", 6), "m2": F.round("m2", 3), "variation": F.round("variation", 6)})


def _repetition_sql(keys: str, more: str = "") -> str:
    v = "CASE WHEN n > 7 THEN d::DOUBLE / n * 10 END"
    return f"""r AS (SELECT *, {v} AS v FROM x), s AS (SELECT *, CASE WHEN v IS NULL THEN {style.NEUTRAL}::DOUBLE ELSE {round3_sql("v")} END AS value FROM r)
    SELECT {keys}{more}, n AS phrases, d AS distinct_phrases, value AS phrase_repetition, CASE WHEN v IS NULL THEN 'too_few_words' ELSE {_band_sql("value", style.REPETITION_BANDS, "typical")} END AS band FROM s"""


@query(
    "group_phrases",
    f"""WITH w AS (SELECT lang, source, regexp_extract_all(lower(text), '{_WORD_SQL}') AS w FROM documents), {_GROUPS_SQL},
    p AS (SELECT lang, source, unnest(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)])) AS p FROM w WHERE len(w) > 2),
    x AS (SELECT g.lang, g.source, count(p) AS n, count(DISTINCT p) AS d FROM g LEFT JOIN p AS x ON {_SAME} GROUP BY ALL), {_repetition_sql("lang, source")}""",
)
def group_phrases(spark, sf_dir):
    return groups.phrase_repetition(_documents(spark, sf_dir), _BY)


@query(
    "conversation_phrases",
    f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{_WORD_SQL}') AS w FROM conversations),
    c AS (SELECT conv_id, flatten(list(w ORDER BY turn)) AS w, sum(greatest(len(w) - 2, 0))::BIGINT AS inside FROM t GROUP BY ALL),
    p AS (SELECT conv_id, CASE WHEN len(w) > 2 THEN list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]) ELSE [] END AS p, len(w) AS words, inside FROM c),
    x AS (SELECT conv_id, words, len(p) AS n, len(list_distinct(p)) AS d, len(p) - inside AS crossing_phrases FROM p), {_repetition_sql("conv_id", ", words, crossing_phrases")}""",
)
def conversation_phrases(spark, sf_dir):
    return ordered.phrase_repetition(_load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


# -- ledgers --------------------------------------------------------------------------------------------------

_KEEP_BIDI = purify.PurifyOptions(strip_bidi=False, form="none")
_SOME = "position % 2 = 0"


@query(
    "replay_ledger",
    f"""WITH {_injected_sql()}, {_CHARS_SQL}, f AS (SELECT *, regexp_matches(c, '{_FLAGGED_SQL}') AND {_SOME} AND {_CATEGORY_SQL} <> 'bidi_control' AS gone FROM h)
    SELECT doc_id, count(*) AS original_length, count(*) FILTER (NOT coalesce(gone, false)) AS purified_length, count(*) FILTER (gone) AS removed_count, 0::BIGINT AS stale_count,
        count(*) FILTER (gone AND {_CATEGORY_SQL} = 'zero_width') AS removed_zero_width, md5(coalesce(string_agg(c, '' ORDER BY position) FILTER (NOT coalesce(gone, false)), '')) AS purified FROM f GROUP BY doc_id""",
)
def replay_ledger(spark, sf_dir):
    """A stored ledger of half of the findings, taken out again by position."""
    docs = _injected(spark, sf_dir)
    ledger = Scratch(spark, "ledger").write(scan.ledger(docs, ["doc_id"], context=False).filter(_SOME).select("doc_id", "position", "codepoint", "category"), "findings")
    out = replay.replay(docs, ledger, ["doc_id"], options=_KEEP_BIDI)
    zero = F.coalesce(F.element_at("removed_by_category", F.lit("zero_width")), F.lit(0).cast("long")).alias("removed_zero_width")
    return out.select("doc_id", "original_length", "purified_length", "removed_count", "stale_count", zero, F.md5(F.col("purified_text").cast("binary")).alias("purified"))


@query(
    "scan_dimension",
    f"""WITH {_injected_sql()}, {_CHARS_SQL}, f AS (SELECT doc_id, position, printf('U+%04X', unicode(c)) AS codepoint FROM h WHERE regexp_matches(c, '{_FLAGGED_SQL}')),
    n(code, name) AS (VALUES {", ".join(f"({c}, '{name}')" for c, _, name in cp.table() if c % 3)})
    SELECT doc_id, position, codepoint, name AS label FROM f LEFT JOIN n ON codepoint = printf('U+%04X', code)""",
)
def scan_dimension(spark, sf_dir):
    """Findings under the names of a supplied table, which lacks a third of the code points."""
    names = cp.dimension(spark).filter(F.conv(F.substring("codepoint", 3, 8), 16, 10).cast("long") % 3 != 0).select("codepoint", F.col("name").alias("label"))
    found = scan.ledger(_injected(spark, sf_dir), ["doc_id"], context=False).select("doc_id", "position", "codepoint")
    return scan.described(found, names)


# -- admission ------------------------------------------------------------------------------------------------

_RATE = admission.Rate(limit=2, seconds=3600)
_WINDOWED_SQL = f"""e AS (SELECT event_id, user_id, ts, to_timestamp(floor(epoch(ts) / {_RATE.seconds}) * {_RATE.seconds}) AS window_start FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS n FROM e)"""


@query("admission_events", f"WITH {_WINDOWED_SQL} SELECT event_id, epoch(window_start)::BIGINT AS window_start, n <= {_RATE.limit} AS admitted FROM r")
def admission_events(spark, sf_dir):
    out = admission.admit(_load(spark, sf_dir, "events"), rate=_RATE)
    return out.select("event_id", F.unix_seconds("window_start").alias("window_start"), "admitted")


_TOTALS_SQL = f"""SELECT user_id, epoch(window_start)::BIGINT AS window_start, count(*) AS requests, least(count(*), {_RATE.limit}) AS admitted, greatest(count(*) - {_RATE.limit}, 0) AS refused"""


@query("admission_totals", f"WITH {_WINDOWED_SQL} {_TOTALS_SQL} FROM r GROUP BY user_id, window_start")
def admission_totals(spark, sf_dir):
    out = admission.totals(_load(spark, sf_dir, "events"), rate=_RATE)
    return out.select(F.col("client").alias("user_id"), F.unix_seconds("window_start").alias("window_start"), "requests", "admitted", "refused")


def _stream(spark, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return streaming.read_texts(spark, path, spark.read.parquet(path).schema)


@query("stream_admission", f"WITH {_WINDOWED_SQL} {_TOTALS_SQL}, max(event_id) FILTER (n = {_RATE.limit}) AS last_id FROM r GROUP BY user_id, window_start")
def stream_admission(spark, sf_dir):
    """The same over a stream of the events, from its keyed state."""
    at = Scratch(spark, "admission").root
    rows = admission_stream.admissions(_stream(spark, sf_dir, "events"), rate=_RATE, late="31 days")
    batches.run(rows, lambda b: b, {"totals": F.lit(True)}, at, f"{at}/state", "update").awaitTermination()
    told = batches.read(spark, at, "totals")
    newest = told.groupBy("client", "window_start").agg(F.max(F.struct("requests", "admitted", "refused", "last_id")).alias("x"))
    return newest.select(F.col("client").alias("user_id"), F.unix_seconds("window_start").alias("window_start"), "x.*")


@query("stream_admission_totals", f"WITH {_WINDOWED_SQL} {_TOTALS_SQL} FROM r GROUP BY user_id, window_start")
def stream_admission_totals(spark, sf_dir):
    """Totals alone over the same stream, from Spark's own state."""
    at = Scratch(spark, "admission").root
    rows = admission_stream.totals(_stream(spark, sf_dir, "events"), rate=_RATE, late="31 days")
    batches.run(rows, lambda b: b, {"totals": F.lit(True)}, at, f"{at}/state", "update").awaitTermination()
    newest = batches.read(spark, at, "totals").groupBy("client", "window_start").agg(F.max(F.struct("requests", "admitted", "refused")).alias("x"))
    return newest.select(F.col("client").alias("user_id"), F.unix_seconds("window_start").alias("window_start"), "x.*")


# -- streams and counters -------------------------------------------------------------------------------------


@query(
    "stream_extract",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'sound' ELSE 'refused' END AS sink, CASE doc_id % 6 WHEN 0 THEN 'UNSUPPORTED' WHEN 3 THEN 'CORRUPT' END AS error_code,
    CASE WHEN doc_id % 3 > 0 THEN md5(text) END AS text_md5 FROM documents""",
)
def stream_extract(spark, sf_dir):
    """Documents as a stream of files under names of four kinds, worked off into two sinks."""
    at = Scratch(spark, "extract").root
    ext = F.element_at(F.array(*map(F.lit, [".doc", ".txt", ".html", ".docx", ".TXT", ".htm"])), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    content = F.encode("text", "UTF-8")
    rows = _stream(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ext).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    file_stream.extract_stream(rows, at, f"{at}/state", _WHOLE).awaitTermination()
    sinks = [batches.read(spark, at, name).withColumn("sink", F.lit(name)) for name in (file_stream.SOUND, file_stream.REFUSED)]
    number = F.regexp_extract("path", r"in/(-?\d+)\.", 1).cast("long").alias("doc_id")
    return sinks[0].unionByName(sinks[1]).select(number, "sink", "error_code", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "stream_categories",
    f"WITH t AS (SELECT x.text, d.lang FROM ({_INJECTED_ONLY}) AS x JOIN documents AS d USING (doc_id)), {_CHARS_SQL} SELECT lang, {_CATEGORY_SQL} AS category, count(*) AS n FROM h WHERE regexp_matches(c, '{_FLAGGED_SQL}') GROUP BY ALL",
)
def stream_categories(spark, sf_dir):
    """The last state of a stream's totals by category."""
    at = Scratch(spark, "categories").root
    rows = _stream(spark, sf_dir, "documents").select("lang", samples.inject(F.col("text"), F.col("doc_id")).alias("text"))
    rollup.run(rows, ["lang"], at, f"{at}/state").awaitTermination()
    return batches.newest(batches.read(spark, at, rollup.TOTALS))


@query("counters", "SELECT t.name, count(*) AS rows, count(text) AS texts, coalesce(sum(length(text)), 0)::BIGINT AS characters, coalesce(max(length(text)), 0)::BIGINT AS longest FROM documents, (VALUES ('stream'), ('table')) AS t(name) GROUP BY ALL")
def counters(spark, sf_dir):
    """What a run and a stream over documents counted as they went."""
    at, seen = Scratch(spark, "counters").root, Counters(spark)
    seen.observe(_documents(spark, sf_dir).select("text"), "table").write.format("noop").mode("overwrite").save()
    rows = seen.observe(_stream(spark, sf_dir, "documents").select("text"), "stream")
    run = rows.select(F.length("text").alias("n")).writeStream.format("noop").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    seen.wait(run)
    out = seen.rows()
    seen.close()
    return out.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("rows", "texts", "characters")], F.max("longest").alias("longest"))
