"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, decontam, htmltext, licenses, mixing, pii, repair, secrets, simhash, sql, topk, toxicity, warc
from .common import table
from .spans import summed_up


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), "n_common", "n_item", "n_answer")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.round_trip(table(spark, sf_dir, "pages")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "fingerprint", "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_up(secrets.scan(table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_up(pii.scan(table(spark, sf_dir, "documents")), pii.KINDS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", F.round(F.col("probabilities")[0], 6).alias("p_low_quality"), F.round(F.col("probabilities")[1], 6).alias("p_toxic"), "toxic")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_warc, op3_html, op4_simhash, op5_secrets, op6_ann, op7_licenses, op8_pii, op9_mixing, op10_toxicity, op11_repair, op12_topk, op13_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": sql.warc(), "op6_ann": sql.nearest(), "op7_licenses": sql.licenses(), "op9_mixing": sql.mixing(), "op11_repair": sql.repair(), "op12_topk": sql.highest(), "op13_codes": sql.codes()}
