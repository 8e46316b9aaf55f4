"""Readers of files, and streams."""

import json

from pyspark.sql import functions as F

from strophe.sources import files as S
from strophe.sources.storage import dropped, settled, stored
from strophe.streaming import events as V


def test_beats_bars_onsets(spark, tmp_path):
    p = tmp_path / "b.txt"
    p.write_text("0.5\t1\n1.0\t2\n1.5\t1\n")
    assert [(r.t, r.beat) for r in S.read_beats(spark, str(p)).orderBy("t").collect()] == [(0.5, 1), (1.0, 2), (1.5, 1)]
    assert [r.t for r in S.read_bars(spark, str(p)).orderBy("t").collect()] == [0.5, 1.5]
    (tmp_path / "o.txt").write_text("")
    assert S.read_onsets(spark, str(tmp_path / "o.txt"), str(p)).count() == 3


def test_chords_of_both_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"chordSequence": [{"start": 0.0, "label": "Am"}, {"start": 2.5, "label": "F#"}]}))
    (tmp_path / "b.json").write_text(json.dumps([[[0.0, 3.0], [1.5, 7.0]], []]))
    got = sorted((r.start, r.label, r.idx) for r in S.read_chords(spark, str(tmp_path)).where("label is not null").collect())
    assert got == [(0.0, "Am", None), (2.5, "F#", None)]
    assert sorted((r.start, r.idx) for r in S.read_chords(spark, str(tmp_path)).where("idx is not null").collect()) == [(0.0, 3), (1.5, 7)]


def test_labelled_events(spark, tmp_path):
    (tmp_path / "x.txt").write_text("0.0\tA\n0.0\tB\n2.0\tC\n5.0\tEnd\n")
    got = [(r.seg, r.start, r.end, r.label) for r in S.read_labelled_events(spark, str(tmp_path / "x.txt")).orderBy("seg").collect()]
    assert got == [(0, 0.0, 2.0, "A"), (1, 2.0, 5.0, "C")]


def test_leadsheets_results_and_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"_form": ["A", "B"], "A": ["C", "G"]}))
    got = sorted((r.name, r.ord, r.item) for r in S.read_leadsheet(spark, str(tmp_path / "l.json")).collect())
    assert got == [("A", 0, "C"), ("A", 1, "G"), ("_form", 0, "A"), ("_form", 1, "B")]
    (tmp_path / "r.csv").write_text("SONG,L\n1,0.5\n")
    r = S.read_results(spark, str(tmp_path / "r.csv"), "song int, l double")
    S.append_results(r, str(tmp_path / "t"))
    S.append_results(r, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"tonal": {"key": {"strength": 0.7}}}))
    assert S.read_documents(spark, str(tmp_path / "d.json"), "tonal struct<key:struct<strength:double>>").select("tonal.key.strength").first()[0] == 0.7
    S.write_json(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_stored_tables_come_and_go(spark):
    t = stored(spark.range(5), "t")
    assert t.count() == 5
    dropped(t)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "hist" else "append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_count_like_tables(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    s = V.stream(spark, str(tmp_path / "in"), "seq_id long, sym string, ts timestamp")
    got = {(r.start, r.seq_id, r.sym): r.n for r in run(V.windowed_hist(s), "hist").collect()}
    want = {(r.w.start, r.seq_id, r.sym): r.n for r in e.groupBy(F.window("ts", "1 hour").alias("w"), "seq_id", "sym").agg(F.count("*").alias("n")).collect()}
    assert got == want
    found = run(V.sessions(s), "sess").collect()
    whole = {(r.seq_id, r.start): r.n for r in V.sessions(e).collect()}
    assert all(whole[r.seq_id, r.start] == r.n for r in found)


def test_what_is_stored_on_the_way_goes(spark):
    import os

    made = []

    def make():
        made.append(stored(spark.range(5), "inner"))
        return made[0].selectExpr("id * 2 AS id")

    out = settled(spark, make, "outer")
    inner = made[0].inputFiles()
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in inner)


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from strophe.sources.storage import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://head:7077"

    with pytest.raises(ValueError):
        shared_dir(Session)
