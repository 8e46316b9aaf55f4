"""Sequences brought to their tempo, under few and many partitions."""

import pytest
from pyspark.sql import functions as F

from strophe.operators import corpus as R
from strophe.operators import statistics as S
from strophe.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_each_factor_is_what_adjusted_gives(spark):
    seq = A.sequences(spark, SF).select("seq_id", "pos", "sym")
    choice = seq.select("seq_id").distinct().where("seq_id % 5 < 4").withColumn("factor", F.element_at(F.array(*map(F.lit, S.FACTORS)), (F.col("seq_id") % 5 + 1).cast("int")))
    want = seq.where("seq_id % 5 = 4")
    for f in S.FACTORS:
        want = want.unionByName(S.adjusted(seq.join(choice.where(F.col("factor") == f), "seq_id", "left_semi"), f))
    assert sorted(map(tuple, S.adjusted_each(seq, choice).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("partitions", [16, 200])
def test_preprocessing_does_not_hang_on_partitions(spark, partitions):
    def rows():
        return sorted(map(tuple, R.preprocessed(A.sequences(spark, SF), A.grid(spark, SF), 0.0002, 0.0006).collect()))

    want, was = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows() == want and want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
