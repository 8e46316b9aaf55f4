"""Canonical tables from the driver's tables. Times are seconds as doubles, positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def position(*by: str, key: str = "seq_id") -> Column:
    return (F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1).cast("int")


def encoded(df: DataFrame, name: str, code: str) -> DataFrame:
    """df with `code`, the rank of `name` among all its values from 0. The dictionary has a row for each distinct value, so ordering it in one task does not grow with df; how it is joined is Spark's choice."""
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    return df.join(names.withColumn(code, (F.row_number().over(Window.orderBy(name)) - 1).cast("int")), name, "left")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol sequences (seq_id, pos, sym, sym_name, t): the events of a user in order of time."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("sym_name"), seconds(F.col("ts")).alias("t"), "event_id")
    return encoded(e.withColumn("pos", position("t", "event_id")), "sym_name", "sym").select("seq_id", "pos", "sym", "sym_name", "t")


def role_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of roles (seq_id, pos, sym): the turns of a conversation."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), "turn", "role")
    return encoded(c.withColumn("pos", position("turn", "role")), "role", "sym").select("seq_id", "pos", "sym")


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of order states (seq_id, pos, sym): the orders of a customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq_id"), "o_orderdate", "o_orderkey", "o_orderpriority")
    return encoded(o.withColumn("pos", position("o_orderdate", "o_orderkey", "o_orderpriority")), "o_orderpriority", "sym").select("seq_id", "pos", "sym")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors (vec_id, vec, label), in series by label: pos is a vector's place among those of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    return e.withColumn("pos", position("vec_id", key="label"))


def grid(spark: SparkSession, sf_dir: str, event_type: str = "view") -> DataFrame:
    """Time grid (seq_id, pos, t): a user's events of one type."""
    s = sequences(spark, sf_dir).where(F.col("sym_name") == event_type)
    return s.select("seq_id", position("t", "pos").alias("pos"), "t")


def hierarchy(spark: SparkSession, sf_dir: str, gap: float = 6 * 3600.0) -> DataFrame:
    """Segmentations on three levels (item, level, seg, start, end, label): a user's weeks, days, and sessions with gaps of at most six hours. A segment begins with its first event and lasts until the next one begins, the last one a second past its last event; its label is its most frequent event type, on ties the smaller name."""
    s = sequences(spark, sf_dir)
    w = Window.partitionBy("seq_id").orderBy("t", "pos")
    s = s.withColumn("new", (F.col("t") - F.lag("t").over(w) > gap).cast("int"))
    keys = F.array(F.struct(F.lit(0).alias("level"), F.floor((F.col("t") - 4 * 86400) / (7 * 86400)).alias("k")), F.struct(F.lit(1).alias("level"), F.floor(F.col("t") / 86400).alias("k")), F.struct(F.lit(2).alias("level"), F.sum(F.coalesce("new", F.lit(0))).over(w).alias("k")))
    e = s.withColumn("keys", keys).select("seq_id", "sym_name", "t", F.explode("keys").alias("x")).select("seq_id", "sym_name", "t", "x.level", "x.k")
    by_sym = e.groupBy("seq_id", "level", "k", "sym_name").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    seg = by_sym.groupBy("seq_id", "level", "k").agg(F.min("t0").alias("start"), F.max("t1").alias("last"), F.min(F.struct((-F.col("n")).alias("n"), "sym_name"))["sym_name"].alias("label"))
    v = Window.partitionBy("seq_id", "level").orderBy("start")
    return seg.select(F.col("seq_id").alias("item"), "level", (F.row_number().over(v) - 1).cast("int").alias("seg"), "start", F.coalesce(F.lead("start").over(v), F.col("last") + 1).alias("end"), "label")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of experiment results (item, param1, param2, ref, method, p, r, l): line items summed up by supplier, return flag, status and quantity class. p and r are shares, l is their harmonic mean."""
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("item"), F.floor(F.col("l_quantity") / 20).cast("int").alias("param1"), F.pmod("l_linenumber", F.lit(2)).alias("param2"), F.col("l_linestatus").alias("ref"), F.col("l_returnflag").alias("method"), "l_discount", "l_tax"
    )
    g = x.groupBy("item", "param1", "param2", "ref", "method").agg(F.round(F.avg("l_discount") * 8, 6).alias("p"), F.round(F.avg("l_tax") * 10, 6).alias("r"))
    return g.withColumn("l", F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 6))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated values (grp, version, date, value): the orders of a market segment's customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("grp"), F.col("o_orderkey").alias("version"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))
