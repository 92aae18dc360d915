"""Vector code compression: product codebooks of integers, searched by Orchard's method.

Every component ``x`` becomes the integer ``floor(256 * x)``; a vector is cut
into equal consecutive parts, and each part position has a codebook of its
own.  ``train`` starts the codebooks from the vectors with the smallest ids
and improves them by rounds of assignment and averaging; ``encode`` gives
every vector its code, one byte a part, and the squared distance to it.

The nearest entry is found by Orchard's search: every entry keeps the others
sorted by their distance from it.  A query starts at some entry, walks that
entry's list, jumps to the list of every entry that improves on it, compares
no entry twice, and stops where the list goes beyond twice its current
distance: by the triangle inequality nothing there can be as near.  The stop
is strict, so an equally near entry of a lower index is still met, and all
arithmetic is in integers: the result equals a scan of the whole codebook.

How it scales: a pass reads the vectors where they lie and shuffles nothing
but one row per task, part and entry (count and sums).  The driver and the
broadcast codebooks hold parts x entries x components numbers whatever the
number of vectors.

Defined cases: vectors that are null or hold a null or a non-finite component
have no row in any result.  The others are returned; one shorter than the
longest, or with integers whose squared distances could leave 64 bits (beyond
3e8 in parts of four components), has no part in the codebooks and a null code
and error.  Fewer vectors than entries give codebooks of that many entries; an
empty table gives none and no rows.  Equal ids at the start are taken in the
order of their integer vectors, null ids last; repeated rows each have their
row and weight.  A length that the number of parts does not divide is an error
of the call.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, stage

SCALE = 256
GROUPS_AT_ONCE = 100_000  # rows of group sums that may be broadcast: a long and a label each
SALTS = 16


def usable(vec: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def codable(vec: Column, size: int, parts: int) -> Column:
    """Whether a usable vector has the common size and integers small enough for squared distances of 64 bits."""
    bound = float(math.isqrt(2 ** 59 * parts // max(size, 1))) / SCALE
    return usable(vec) & (F.size(vec) == size) & ~F.exists(vec, lambda x: F.abs(x.cast("double")) >= bound)


def integers(col: pa.Array, parts: int, width: int) -> np.ndarray:
    """``floor(256 * x)`` of all components, shaped (rows, parts, components of a part)."""
    x = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return x.astype(np.int64).reshape(len(col), parts, width)


class Codebook:
    """Entries of one part position and every entry's list of the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.lists = np.argsort(self.apart, axis=1, kind="stable")
        # where a search starts: the entry next in the first component
        self.by_first = np.argsort(entries[:, 0], kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of every row (ties: the lower index) and its squared distance,
        all rows walking their lists side by side."""
        n, k = len(x), len(self.entries)
        at = np.searchsorted(self.entries[self.by_first, 0], x[:, 0])
        best = self.by_first[np.minimum(at, k - 1)]
        dist = ((x - self.entries[best]) ** 2).sum(1)
        seen = np.zeros((n, k), dtype=bool)
        seen[np.arange(n), best] = True
        place = np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        while len(live):
            here = best[live]
            other = self.lists[here, place[live]]
            # apart > 2 x distance, in squares: nothing further down this list can be as near
            on = self.apart[here, other] <= 4 * dist[live]
            live, other = live[on], other[on]
            place[live] += 1
            fresh = ~seen[live, other]
            row, entry = live[fresh], other[fresh]
            seen[row, entry] = True
            d = ((x[row] - self.entries[entry]) ** 2).sum(1)
            better = (d < dist[row]) | ((d == dist[row]) & (entry < best[row]))
            row = row[better]
            best[row], dist[row], place[row] = entry[better], d[better], 0
            live = live[place[live] < k]
        return best, dist


def first_entries(df: DataFrame, vec: str, key: str, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, component) from the vectors of the smallest ids; at most
    ``entries`` rows reach the driver."""
    size = df.where(usable(F.col(vec))).agg(F.max(F.size(vec))).first()[0]
    if not size:
        return None
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    whole = F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(x * SCALE))
    rows = (df.where(codable(F.col(vec), size, parts)).select(F.col(key).alias("k"), F.col(vec).alias("v"), whole.alias("w"))
            .orderBy(F.col("k").asc_nulls_last(), "w").limit(entries).select("v").collect())
    if not rows:
        return None
    return integers(pa.array([r.v for r in rows], type=pa.list_(pa.float64())), parts, size // parts).transpose(1, 0, 2).copy()


def _sums(df: DataFrame, vec: str, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total by component) of all assigned parts, combined in the task first."""
    parts, k, width = books.shape

    def run(batches):
        searched = [Codebook(b) for b in books]
        n = np.zeros((parts, k), dtype=np.int64)
        total = np.zeros((parts, k, width), dtype=object)  # Python's integers: no overflow in a long task
        for b in slices(batches):
            x = integers(b.column(0), parts, width)
            for p in range(parts):
                best, _ = searched[p].nearest(x[:, p])
                n[p] += np.bincount(best, minlength=k)
                part = np.zeros((k, width), dtype=np.int64)
                np.add.at(part, best, x[:, p])
                total[p] += part
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()),
             pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))],
            names=["part", "entry", "n", "total"])

    partial = df.where(codable(F.col(vec), parts * width, parts)).select(vec).mapInArrow(run, "part int, entry int, n long, total array<string>")
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)


def train(df: DataFrame, vec: str = "embedding", key: str = "vec_id", parts: int = 16, entries: int = 64,
          rounds: int = 2) -> np.ndarray | None:
    """Codebooks (part, entry, component) after ``rounds``; None for a table without vectors.

    A round assigns every part to its nearest entry and replaces each entry by the
    componentwise floor of its parts' mean; an entry without parts stays.
    """
    books = first_entries(df, vec, key, parts, entries)
    for _ in range(rounds if books is not None else 0):
        new = books.copy()
        for r in _sums(df, vec, books).collect():  # parts x entries rows at most
            new[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(books.shape[2])]
        books = new
    return books


def encode(df: DataFrame, books: np.ndarray | None, vec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every usable vector with ``code`` (two hex digits a part) and
    ``error`` (squared distance to the entries, summed over the parts)."""
    made = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    keep = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    rows = df.where(usable(F.col(vec)))
    if books is None:
        return rows.select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batch: pa.RecordBatch) -> dict:
        vectors = batch.column(batch.schema.get_field_index("_vector"))
        there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        code, error = np.full(len(vectors), None, dtype=object), np.full(len(vectors), None, dtype=object)
        x = integers(vectors.drop_null(), parts, width)
        found = [Codebook(b).nearest(x[:, p]) for p, b in enumerate(books)]
        code[there] = ["".join(row) for row in digits[np.stack([best for best, _ in found], axis=1)].tolist()]
        error[there] = sum(d for _, d in found).tolist()
        return {"code": code.tolist(), "error": error.tolist()}

    vector = F.when(codable(F.col(vec), parts * width, parts), F.col(vec))
    return map_batches(rows.select(*keep, vector.alias("_vector")), run, made, keep=keep)


def codebooks_digest(books: np.ndarray | None) -> str:
    """Lowercase hex SHA-256 of all components by part, entry and place, comma-joined."""
    text = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    return hashlib.sha256(text.encode()).hexdigest()


def with_group_sum(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``df`` (read twice: a stored table) with the sum of ``value`` over the rows of equal
    ``group``, nulls together.

    Groups are summed before the shuffle.  Their sums are broadcast when they are
    counted to be few; else they are joined with the rows, each group dealt out
    by salt, so that one frequent value is no task of its own.
    """
    sums = stage(df.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias(out)), "group-sums")
    if sums.count() <= GROUPS_AT_ONCE:
        return df.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    dealt = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.withColumn("_r", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_s")), "left").drop("_g", "_r", "_s")
