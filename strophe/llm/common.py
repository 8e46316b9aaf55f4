"""What the operators share: tables, the shared folder, words and batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.adapters import table
from ..sources.storage import dropped, passing, redealt, scratch, settled, shared_dir, stored

__all__ = ["WORD", "dropped", "given_back", "n_words", "passing", "per_batch", "redealt", "scratch", "settled", "shared_dir", "slices", "stored", "table"]

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and, unless one row alone has more, `size` bytes of strings; so what a step holds follows the texts and not the file."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(held)))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def given_back() -> None:
    """Returns memory that a task of this worker no longer needs to the system: workers stay for the next stage, beside which the executor's other work needs room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def per_batch(df: DataFrame, schema: str | StructType, f: Callable[[pa.RecordBatch], dict | None], size: int = 1 << 24) -> DataFrame:
    """A row-local step in Python: f turns a slice of a batch (slices), of so many bytes at most, into the output's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, size=size):
                if cols := f(part):
                    yield pa.RecordBatch.from_arrays([cols[x.name] if isinstance(cols[x.name], pa.Array) else pa.array(cols[x.name], x.type) for x in out], schema=out)
        given_back()

    return df.mapInArrow(run, schema)


def n_words(text) -> F.Column:
    """Number of words in a text; 0 for null. Words become one sign each and spaces go, so no list of a long text's words is made."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "#"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")
