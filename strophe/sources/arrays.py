"""A data source for arrays in files: `.npy`, `.npz` and MATLAB's `.mat`, as rows (path, row, vector)."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, row long, vector array<double>"
#: Bytes of a partition, and of a batch of rows within it.
PARTITION, BATCH = 64 << 20, 4 << 20
#: Fixed values of MATLAB's level 5 format: numbers of element types and their numpy types, and numbers of array classes.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15
MAT_STRUCT, MAT_NUMBERS = 2, range(6, 16)


@dataclass
class Piece(InputPartition):
    """Some files, whole, or rows [start, stop) of one."""

    paths: list[str]
    start: int = 0
    stop: int | None = None


class Forward:
    """Bytes that are read once, from front to back; skip() goes on without keeping them."""

    def __init__(self, more):
        self.more, self.held = more, b""

    def read(self, n: int = -1) -> bytes:
        parts = [self.held]
        have = len(self.held)
        while n < 0 or have < n:
            b = self.more()
            if not b:
                break
            parts.append(b)
            have += len(b)
        data = b"".join(parts)
        n = len(data) if n < 0 else n
        self.held = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        while n > 0:
            b = self.read(min(n, BATCH))
            if not b:
                return
            n -= len(b)


def _unpacked(file, size: int) -> Forward:
    """The contents of a compressed element of so many bytes."""
    z, left = zlib.decompressobj(), size

    def more() -> bytes:
        nonlocal left
        out = b""
        while not out and left > 0:
            b = file.read(min(left, 1 << 16))
            if not b:
                left = 0
                break
            left -= len(b)
            out = z.decompress(b)
        return out or z.flush()

    return Forward(more)


def _skip(file, n: int) -> None:
    if isinstance(file, Forward):
        file.skip(n)
    elif n:
        file.seek(n, 1)


@dataclass
class Array:
    """Where an array lies: the file stands at its first byte."""

    file: object
    shape: tuple[int, ...]
    dtype: np.dtype
    by_column: bool

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) if self.shape else 1

    def read(self, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) of the rows from start to stop, some at a time."""
        n, size = self.width, self.dtype.itemsize
        if self.by_column and n > 1:  # each column has its part of the rows, so the rows asked for are held together
            out = np.empty((stop - start, n))
            for c in range(n):
                _skip(self.file, start * size)
                out[:, c] = np.frombuffer(self.file.read((stop - start) * size), self.dtype)
                _skip(self.file, (self.rows - stop) * size)
            if len(self.shape) > 2:  # the other axes are laid out by column as well
                out = out.reshape(stop - start, *self.shape[:0:-1]).transpose(0, *range(len(self.shape) - 1, 0, -1)).reshape(stop - start, n)
            yield start, out
            return
        _skip(self.file, start * n * size)
        step = max(1, BATCH // max(1, n * size))
        for at in range(start, stop, step):
            k = min(step, stop - at)
            yield at, np.frombuffer(self.file.read(k * n * size), self.dtype).reshape(k, n).astype(np.float64)


def npy(file) -> Array:
    """The array of a `.npy` file."""
    version = np.lib.format.read_magic(file)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.kind not in "biuf":
        raise ValueError(f"arrays of {dtype} are not numbers")
    return Array(file, shape, dtype, by_column)


def _element(file, end: str) -> tuple[int, int, int, bytes | None]:
    """The next element's type, its bytes, those up to the one after it, and its data if that lies in its head."""
    head = file.read(8)
    if len(head) < 8:
        return 0, 0, 0, None
    kind, size = np.frombuffer(head[:4], f"{end}u4")[0], np.frombuffer(head[4:], f"{end}u4")[0]
    if kind >> 16:
        return int(kind & 0xFFFF), int(kind >> 16), 0, head[4 : 4 + int(kind >> 16)]
    return int(kind), int(size), int(size) if kind == MAT_COMPRESSED else int(size) + -int(size) % 8, None


def _data(file, end: str) -> tuple[int, bytes]:
    kind, size, whole, data = _element(file, end)
    return kind, data if data is not None else file.read(whole)[:size]


def mat(file, name: str) -> Array | None:
    """The array of a name, or of a field of a structure ("structure.field"), in a `.mat` file of level 5; None if there is none."""
    head = file.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 file")
    end = "<" if head[126:128] == b"IM" else ">"
    want, _, field = name.partition(".")
    while True:
        kind, size, whole, _ = _element(file, end)
        if kind == 0:
            return None
        if kind == MAT_COMPRESSED:
            inner = _unpacked(file, size)
            _element(inner, end)
            if (found := _matrix(inner, end, want, field)) is not None:
                return found
            inner.read()
        elif kind == MAT_MATRIX:
            at = file.tell()
            if (found := _matrix(file, end, want, field)) is not None:
                return found
            file.seek(at + whole)
        else:
            _skip(file, whole)


def _matrix(file, end: str, want: str | None, field: str) -> Array | None:
    """The wanted array from a matrix element whose head is read; None if it is another's."""
    cls = _data(file, end)[1][0 if end == "<" else 3]
    dims = tuple(int(x) for x in np.frombuffer(_data(file, end)[1], f"{end}i4"))
    name = _data(file, end)[1].decode("latin-1")
    if want is not None and name != want:
        return None
    if cls in MAT_NUMBERS and not field:
        kind, size, _, data = _element(file, end)
        dtype = np.dtype(f"{end}{MAT_TYPES[kind]}")
        return Array(io.BytesIO(data) if data is not None else file, dims, dtype, True)
    if cls == MAT_STRUCT and field:
        length = int(np.frombuffer(_data(file, end)[1], f"{end}i4")[0])
        names = _data(file, end)[1]
        for i in range(0, len(names), length):
            one = names[i : i + length].split(b"\0")[0].decode("latin-1")
            _, _, whole, _ = _element(file, end)
            if one == field:
                return _matrix(file, end, None, "")
            _skip(file, whole)
    return None


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.folder, self.name = options["path"], options.get("array", "")
        self.partition = int(options.get("partitionbytes", PARTITION))
        self.only: str | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A path and bounds of rows are applied before files are opened; Spark applies all filters again."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("path",) and isinstance(f, EqualTo):
                self.only = f.value
            elif at == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = int(f.value) + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def _opened(self, path: str) -> Iterator[tuple[str, Array]]:
        """The arrays of a file, each under its own path."""
        store, _ = pafs.FileSystem.from_uri(self.folder)
        with store.open_input_file(path) as file:
            if path.endswith(".npz"):
                with zipfile.ZipFile(file) as z:
                    for member in z.namelist():
                        with z.open(member) as raw:
                            yield f"{path}!{member.removesuffix('.npy')}", npy(Forward(lambda raw=raw: raw.read(1 << 16)))
            elif path.endswith(".mat"):
                if (found := mat(file, self.name)) is not None:
                    yield path, found
            else:
                yield path, npy(file)

    def partitions(self) -> list[Piece]:
        """Files of up to a partition's size together, in order of their paths; of larger ones the head is read, and their rows are dealt out."""
        store, path = pafs.FileSystem.from_uri(self.folder)
        info = store.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
        out, held, size = [], [], 0
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.extension in ("npy", "npz", "mat")), key=lambda f: f.path):
            if self.only is not None and self.only.split("!")[0] != f.path:
                continue
            if f.size > self.partition and f.extension != "npz":
                for _, a in self._opened(f.path):
                    step = max(1, self.partition // max(1, a.width * (8 if a.by_column else a.dtype.itemsize)))
                    low, high = self.low, a.rows if self.high is None else min(self.high, a.rows)
                    out += [Piece([f.path], at, min(at + step, high)) for at in range(low, high, step)]
                continue
            if held and size + f.size > self.partition:
                out.append(Piece(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Piece(held)] if held or not out else out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for file in piece.paths:
            for path, a in self._opened(file):
                start = max(piece.start, self.low)
                stop = min(x for x in (piece.stop, self.high, a.rows) if x is not None)
                if start >= stop or self.only not in (None, path):
                    continue
                for at, x in a.read(start, stop):
                    step = max(1, BATCH // max(1, 8 * x.shape[1]))
                    for i in range(0, len(x), step):
                        part = np.ascontiguousarray(x[i : i + step])
                        ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                        made = {"path": lambda: pa.array([path] * len(part), pa.string()), "row": lambda: pa.array(at + i + np.arange(len(part)), pa.int64()), "vector": lambda: pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))}
                        yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Writes rows (name, vector) to `<name>-<number>.npy`, in the order in which tasks have them; a file has so many rows at most, which a task holds. Files get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.folder, self.rows = options["path"], int(options.get("rowsperfile", 1 << 16))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(path, recursive=True)
        out: list[tuple[str, str]] = []
        name, number, held, n = None, 0, [], 0

        def flush() -> None:
            nonlocal held, n, number
            if n:
                x = np.concatenate(held)
                tmp = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(tmp) as file:
                    np.lib.format.write_array_header_1_0(file, np.lib.format.header_data_from_array_1_0(x))
                    file.write(x.tobytes())
                out.append((tmp, f"{path}/{name}-{number:05d}.npy"))
                held, n, number = [], 0, number + 1

        for b in batches:
            names = b.column("name").to_pylist()
            v = b.column("vector")
            ends = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))))
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = 0
            while at < len(names):
                if names[at] != name:
                    flush()
                    name, number = names[at], 0
                to = at + 1
                while to < len(names) and names[to] == name and to - at < self.rows - n:
                    to += 1
                held.append(x[ends[at] : ends[to]].reshape(to - at, -1))
                n += to - at
                if n == self.rows:
                    flush()
                at = to
        flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            for tmp, path in m.files if m else []:
                store.move(tmp, path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            for tmp, _path in m.files if m else []:
                store.delete_file(tmp)


class Arrays(DataSource):
    """spark.read.format("arrays").load(folder): a row for each row of each array in `.npy`, `.npz` and `.mat` files below a folder, or of one file: (path, row, vector). The option `array` names the array of a `.mat` file, or a structure's field as "structure.field"; partitionBytes is a partition's size.

    Arrays of more axes have their first as rows, the others end to end; those of one axis have vectors of one value, a number is one row. All numbers become doubles. Large files are cut into ranges of rows, which are read by themselves, so no task holds a file; only a compressed file is read from its front. A schema with fewer columns (spark.read.schema) makes only those; filters on path and row are applied before files are opened.

    Arrays of objects, strings or complex numbers are refused. A `.mat` file without the array gives no rows, an empty folder neither.

    df.write.format("arrays").mode("append").save(folder) writes rows (name, vector) to `.npy` files.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known and filters pushed into it."""
    spark.dataSource.register(Arrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
