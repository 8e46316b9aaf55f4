"""The tests of matrices in tiles once more, with several stripes in a bunch, to which the other side is sent once."""

import pytest
from pyspark.sql import functions as F

from strophe.operators import tiles
from tests.test_tiles import *  # noqa: F403


@pytest.fixture(autouse=True)
def bunches(monkeypatch, small):  # noqa: F405
    monkeypatch.setattr(tiles, "SENT", 2)


def test_the_other_side_is_sent_to_bunches_and_not_to_stripes(spark):
    for n in (400, 1600):
        f = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("pos"), F.array(F.lit(1.0)).alias("vec"))
        x = tiles.stripes(f, f, ["k"], lambda s: iter([[[len(s.rows.pos)], [sum(len(v.pos) for v in s.columns)]]]), "rows int, seen int").cache()
        assert sorted(map(tuple, x.collect())) == [(1, 16, n)] * (n // 16)
        sides = x._jdf.queryExecution().optimizedPlan().toString()
        assert "bunch" in sides
