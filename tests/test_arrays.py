"""Arrays in files: what numpy and MATLAB's format hold comes back, in few and many partitions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.sources import arrays as R


def got(df):
    return {(r.path.rsplit("/", 1)[1], r.row): r.vector for r in df.collect()}


def want(name, x):
    x = np.asarray(x, float)
    x = x.reshape(x.shape[0] if x.ndim else 1, x[:1].size if x.ndim else 1)
    return {(name, i): v.tolist() for i, v in enumerate(x)}


@pytest.mark.parametrize("size", [200, 1 << 26])
def test_numpy_files_come_back(spark, tmp_path, size):
    rng = np.random.default_rng(0)
    kinds = {"a": rng.normal(size=(37, 5)), "b": rng.integers(-9, 9, (11, 2, 3)).astype(">i2"), "c": np.asfortranarray(rng.normal(size=(29, 4)).astype(np.float32)), "d": rng.normal(size=50), "e": np.array(3.5), "f": np.zeros((0, 4)), "g": rng.random((6, 3)) > 0.5, "h": np.asfortranarray(rng.normal(size=(13, 2, 3)))}
    all_ = {}
    for k, x in kinds.items():
        np.save(tmp_path / f"{k}.npy", x)
        all_ |= want(f"{k}.npy", x)
    np.savez_compressed(tmp_path / "z.npz", first=kinds["a"], second=kinds["d"])
    all_ |= want("z.npz!first", kinds["a"]) | want("z.npz!second", kinds["d"])
    df = R.registered(spark).read.format("arrays").option("partitionBytes", size).load(f"file://{tmp_path}")
    assert got(df) == all_
    assert (df.rdd.getNumPartitions() > 10) == (size == 200)


def test_rows_and_columns_are_chosen_before_files_are_read(spark, tmp_path):
    x = np.arange(3000.0).reshape(1000, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", x + 1)
    path = f"{tmp_path}/x.npy"
    df = R.registered(spark).read.format("arrays").option("partitionBytes", 2400).load(f"file://{tmp_path}")
    some = df.where((F.col("path") == path) & (F.col("row") >= 300) & (F.col("row") < 350))
    assert sorted(r.row for r in some.collect()) == list(range(300, 350))
    reader = R.ArrayReader(df.schema, {"path": f"file://{tmp_path}", "partitionbytes": "2400"})
    list(reader.pushFilters([R.EqualTo(("path",), path), R.GreaterThanOrEqual(("row",), 300), R.LessThan(("row",), 350)]))
    assert [(p.paths, p.start, p.stop) for p in reader.partitions()] == [([path], 300, 350)]
    narrow = spark.read.format("arrays").schema("row long").load(f"file://{tmp_path}")
    assert narrow.columns == ["row"] and narrow.agg(F.sum("row")).first()[0] == 999000


def mat_element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_matrix(name, cls, dims, rest):
    return mat_element(14, mat_element(6, struct.pack("<II", cls, 0)) + mat_element(5, struct.pack(f"<{len(dims)}i", *dims)) + mat_element(1, name.encode()) + rest)


def mat_array(name, x):
    return mat_matrix(name, 6, x.shape, mat_element(9, np.asfortranarray(x, "<f8").tobytes("F")))


def small(kind, data):
    return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0")


@pytest.mark.parametrize("size", [100, 1 << 26])
@pytest.mark.parametrize("packed", [False, True])
def test_matlab_files_come_back(spark, tmp_path, size, packed):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(17, 4)), rng.normal(size=(9, 9))
    names = b"".join(n.encode().ljust(16, b"\0") for n in ("Plain", "Fused/Both"))
    both = mat_matrix("Ws", 2, (1, 1), small(5, struct.pack("<i", 16)) + mat_element(1, names) + mat_array("", a) + mat_array("", b))
    tiny = mat_matrix("t", 9, (1, 3), small(2, bytes([1, 2, 3])))
    parts = [mat_array("other", a + 1), both, tiny]
    if packed:
        parts = [struct.pack("<II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    (tmp_path / "m.mat").write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + b"\0\1IM" + b"".join(parts))
    read = R.registered(spark).read.format("arrays").option("partitionBytes", size)
    for name, x in (("Ws.Fused/Both", b), ("Ws.Plain", a), ("other", a + 1), ("t", [[1, 2, 3]])):
        assert got(read.option("array", name).load(f"file://{tmp_path}")) == want("m.mat", x)
    assert got(read.option("array", "none").load(f"file://{tmp_path}")) == {}


def test_written_rows_come_back(spark, tmp_path):
    rows = [(n, [float(i), n == "a", -i]) for n in "ab" for i in range(25)]
    df = spark.createDataFrame([(n, i % 25, [float(x) for x in v]) for i, (n, v) in enumerate(rows)], "name string, k int, vector array<double>")
    R.registered(spark)
    df.repartition(3, "name").sortWithinPartitions("name", "k").select("name", "vector").write.format("arrays").option("rowsPerFile", 10).mode("append").save(f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{n}-0000{k}.npy" for n in "ab" for k in range(3)]
    assert np.concatenate([np.load(tmp_path / "out" / f"a-0000{k}.npy") for k in range(3)]).tolist() == [[float(i), 1.0, float(-i)] for i in range(25)]
    assert spark.read.format("arrays").load(f"file://{tmp_path}/out").count() == 50


def test_empty_folders_and_other_arrays(spark, tmp_path):
    assert R.registered(spark).read.format("arrays").load(f"file://{tmp_path}").count() == 0
    np.save(tmp_path / "s.npy", np.array(["x"]))
    with pytest.raises(Exception, match="are not numbers"):
        spark.read.format("arrays").load(f"file://{tmp_path}").count()
