"""Whole-row plans: analysis of texts, files to findings, corpus roll-ups, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import purify as purify_ops
from ..operators import scan, stylometry, validate
from ..settings import Settings
from ..sources import files


def analyze(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df with error_code, has_hidden_unicode, hidden_character_count, anomalies, signals, composite_score,
    confidence, summary, character_count and word_count.  Rows with an error keep nulls for the rest.  No shuffle."""
    # the reading of refused rows is cut off before any measure is taken of them
    out = validate.validate(df, text, settings).withColumn("__sound", F.when(F.col("error_code").isNull(), F.col(text)))
    t = F.col("__sound")
    out = out.withColumns({"anomalies": scan.findings(t), "hidden_character_count": scan.hidden_count(t), "character_count": F.length(t).cast("long"), "word_count": stylometry.word_count(t)})
    out = out.withColumn("has_hidden_unicode", F.col("hidden_character_count") > 0)
    out = stylometry.stylometry(out, "__sound").drop("__sound")
    return out.withMetadata("composite_score", {"comment": stylometry.DISCLAIMER})


def purify(df: DataFrame, text: str = "text", options: purify_ops.PurifyOptions = purify_ops.PurifyOptions(), settings: Settings = Settings()) -> DataFrame:
    """df with error_code and the fields of a purification; rows with an error keep nulls."""
    out = validate.validate(df, text, settings).withColumn("__sound", F.when(F.col("error_code").isNull(), F.col(text)))
    return purify_ops.purify(out, "__sound", options).drop("__sound")


def extract_and_analyze(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """Files under path: extraction, and the analysis of every text found."""
    found = files.extract(files.read_files(spark, path), settings).withColumnRenamed("error_code", "file_error")
    return analyze(found, "text", settings)


def corpus_profile(df: DataFrame, by: list[str], text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Roll-up of analyses by group: texts, texts with findings, findings, mean composite."""
    rows = analyze(df.select(*by, F.col(text).alias("text")), "text", settings).filter("error_code is null")
    return rows.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.sum(F.col("has_hidden_unicode").cast("long")).alias("texts_with_hidden"),
        F.sum("hidden_character_count").alias("hidden_characters"),
        F.avg("composite_score").alias("mean_composite"),
    )


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok", __version__, True)], "status string, version string, ready boolean")
