"""Readers and writers of the files that sequences come in. Schemas are declared, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated times with an optional beat number: (path, t, beat)."""
    return spark.read.csv(path, sep="\t", schema="t double, beat double").select(F.input_file_name().alias("path"), "t", F.col("beat").cast("int").alias("beat"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The times of the first beats of bars: (path, t)."""
    return read_beats(spark, path).where("beat = 1").select("path", "t")


def read_onsets(spark: SparkSession, path: str, beats: str) -> DataFrame:
    """Onset times (path, t); if there are none in all of path, the beats."""
    own = read_beats(spark, path).select("path", "t")
    return own if own.take(1) else read_beats(spark, beats).select("path", "t")


def read_chords(spark: SparkSession, path: str) -> DataFrame:
    """Chords (path, start, label, idx) from JSON documents of either layout: an object with chordSequence (start and label; idx null), or a list whose first item is the list of (start, index) pairs (label null)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    a = raw.select("path", F.explode(F.from_json("value", "struct<chordSequence:array<struct<start:double,label:string>>>")["chordSequence"]).alias("c")).select("path", "c.start", "c.label", F.lit(None).cast("int").alias("idx"))
    b = raw.where(F.trim("value").startswith("[")).select("path", F.explode(F.from_json("value", "array<array<array<double>>>")[0]).alias("c"))
    return a.unionByName(b.select("path", F.col("c")[0].alias("start"), F.lit(None).cast("string").alias("label"), F.col("c")[1].cast("int").alias("idx")))


def read_labelled_events(spark: SparkSession, path: str) -> DataFrame:
    """Segments (path, seg, start, end, label) from tab-separated times and labels: of repeated times the first row counts, the last row only ends."""
    from pyspark.sql import Window

    rows = spark.read.csv(path, sep="\t", schema="t double, label string").select(F.input_file_name().alias("path"), "t", "label", F.monotonically_increasing_id().alias("n"))
    first = rows.groupBy("path", "t").agg(F.min_by("label", "n").alias("label"))
    w = Window.partitionBy("path").orderBy("t")
    return first.select("path", (F.row_number().over(w) - 1).cast("int").alias("seg"), F.col("t").alias("start"), F.lead("t").over(w).alias("end"), "label").where("`end` is not null")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table from CSV with a header."""
    return spark.read.csv(path, header=True, schema=schema)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON documents, one for each file, by their declared schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_leadsheet(spark: SparkSession, path: str) -> DataFrame:
    """Rules (path, name, ord, item) of song forms: JSON objects whose members are lists of section names or chords."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "items"))
    return raw.select("path", "name", F.posexplode("items").alias("ord", "item"))


def append_results(new: DataFrame, path: str) -> None:
    """Appends rows to a Parquet result table."""
    new.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
