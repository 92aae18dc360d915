"""Helpers shared by the operators: staged tables, Arrow row mapping, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 8 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor never recomputes what lies before, and
    values made per task (block numbers) stay as written.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType,
                keep: list[str] | None = None, size: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> {new column: values}`` beside the kept columns.

    ``keep`` (default: all) are passed through; kept columns whose names clash
    with new ones are replaced by the new ones.  ``fn`` gets batches of about
    ``size`` bytes.
    """
    new = [f.name for f in schema]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    out = T.StructType([df.schema[c] for c in keep] + list(schema))
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size):
            made = fn(b)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            cols += [made[n] if isinstance(made[n], (pa.Array, pa.ChunkedArray))
                     else pa.array(made[n], type=types[n]) for n in new]
            yield pa.RecordBatch.from_arrays(cols, names=keep + new)

    return df.mapInArrow(run, out)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, one row at least, so that
    what a function makes of a batch stays a bounded multiple of that."""
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    release()


def release() -> None:
    """Give freed memory back: Python workers live on between tasks, several to an executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_types(schema: T.StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return {f.name: to_arrow_type(f.dataType) for f in schema}


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows of a string column, and each row's offset (null: empty)."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of many texts in one compact buffer.

    ``data`` holds the words' bytes without separators, word ``i`` is
    ``data[off[i]:off[i + 1]]``, document ``d`` has words ``doc[d]:doc[d + 1]``.
    """

    def __init__(self, col: pa.Array, byte_map: np.ndarray):
        raw, doff = text_buffer(col)
        mapped = byte_map[raw]
        inside = mapped != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = doff[:-1][doff[:-1] < len(raw)]
        first[at] |= inside[at]
        starts = np.flatnonzero(first)
        before = np.cumsum(inside)
        self.data = mapped[inside]
        if byte_map[0]:
            self.data[self.data == byte_map[0]] = 0
        self.off = np.append(before[starts] - 1, len(self.data)).astype(np.int64)
        self.doc = np.searchsorted(starts, doff)

    def arrow(self) -> pa.Array:
        """The words as an Arrow array of bytes."""
        return pa.Array.from_buffers(pa.large_binary(), len(self.off) - 1,
                                     [None, pa.py_buffer(self.off), pa.py_buffer(self.data)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Index of each word in the array of distinct words, and that array."""
        d = self.arrow().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def ascii_lower_map(separators: list[int]) -> np.ndarray:
    """Byte map for ``Words``: A-Z lower-cased, separators to 0."""
    m = np.arange(256, dtype=np.uint8)
    m[65:91] += 32
    m[separators] = 0
    return m


# ASCII white space: space and 0x09-0x0D.  A zero byte is no separator but
# would read as one in the map, so it is moved to a byte UTF-8 never uses.
def white_space_map() -> np.ndarray:
    m = ascii_lower_map([])
    m[0] = 0xFF
    m[[0x20, *range(0x09, 0x0E)]] = 0
    return m


def alnum_map() -> np.ndarray:
    """Letters a-z, digits and all non-ASCII bytes are words; A-Z is lower-cased."""
    return ascii_lower_map([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i]+1, ... (lens[i] of them)`` of all i, concatenated."""
    total = int(lens.sum())
    out = np.ones(total, dtype=np.int64)
    if not total:
        return out
    has = lens > 0
    s, n = starts[has].astype(np.int64), lens[has].astype(np.int64)
    first = np.cumsum(n) - n
    out[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    out[0] = s[0]
    return np.cumsum(out)
