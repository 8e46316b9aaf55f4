"""Files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources import arrays
from ..sources.storage import passing, scratch
from .registry import query


@query("SELECT label::VARCHAR AS name, pos::BIGINT AS row, len(vec)::INT AS n, vec[1] AS first, vec[-1] AS last, round(list_sum(vec), 6) + 0.0 AS total FROM feat WHERE label IS NOT NULL")
def array_files(spark, d):
    """The series of vectors as `.npy` files, read back as rows."""
    spark = arrays.registered(spark)
    folder = scratch(spark, "arrays")
    f = A.features(spark, d).where("label is not null").select(F.col("label").cast("string").alias("name"), "pos", F.col("vec").alias("vector"))
    # a whole series is one file's rows in order, so a file's size is what its writer may hold
    f.repartition("name").sortWithinPartitions("name", "pos").select("name", "vector").write.format("arrays").option("rowsPerFile", 4096).mode("append").save(folder)
    passing(spark, folder)
    x = spark.read.format("arrays").load(folder)
    file = F.regexp_extract("path", r"([^/]*)-(\d+)\.npy$", 1)
    number = F.regexp_extract("path", r"-(\d+)\.npy$", 1).cast("long")
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b), 6) + 0.0
    return x.select(file.alias("name"), (number * 4096 + F.col("row")).alias("row"), F.size("vector").alias("n"), F.col("vector")[0].alias("first"), F.element_at("vector", -1).alias("last"), total.alias("total"))
