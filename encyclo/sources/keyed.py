"""Stored tables by key: buckets with versions, so that a change rewrites what it touches.

A keyed table is a folder::

    data/v=<n>/bucket=<b>/part-*.parquet    rows written by commit n
    _commits/<n>.json                       for every bucket, the commits whose rows it holds

A row's bucket is a hash of its key.  ``merge`` reads the buckets of the changed
keys, joins old and new rows inside them and writes these buckets anew;
``append`` writes new rows beside the old.  Both then commit the list with one
rename.  Readers follow the newest commit, so they see a batch wholly or not at
all; files of a batch that died before its commit are never listed, and the
next commit of that number overwrites them.

Every write names its batch as ``(source, number)``, numbers of a source rising.
A batch that is committed already does nothing; one that brings no change
writes no rows.  A table has one writer at a time.

The list has one entry a bucket, and the driver holds the list and the touched
bucket numbers: both are bounded by the number of buckets, which is fixed when
the table is made.  ``buckets`` should let one bucket fit a task comfortably
(bytes of the whole table / 128 MB, say).  Where one key may have many rows,
``spread`` deals each key's rows out over so many buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

Batch = tuple[str, int]


class KeyedTable:
    """Rows of ``schema`` by ``key``; one row or several rows a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64, spread: int = 1):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.spread = buckets, spread
        self.schema = T.StructType.fromDDL(schema)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []

    # -- commits --------------------------------------------------------
    def _commits(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, number: int) -> dict:
        stream = self._fs.open(self._place(f"_commits/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict:
        """The newest commit: its number, versions by bucket, and last batch of each source."""
        numbers = self._commits()
        if not numbers:
            return {"number": -1, "buckets": self.buckets, "spread": self.spread, "versions": {}, "sources": {}}
        state = self._state(numbers[-1])
        if (state["buckets"], state["spread"]) != (self.buckets, self.spread):
            raise ValueError(f"{self.path} was made with {state['buckets']} buckets and a spread of {state['spread']}")
        return state

    def done(self, batch: Batch) -> bool:
        return self.last()["sources"].get(batch[0], -1) >= batch[1]

    def _commit(self, state: dict, batch: Batch, versions: dict[str, list[int]]) -> None:
        """Write the list beside the commits and rename it: a commit is there as a whole or not at all."""
        number = state["number"] + 1
        text = json.dumps(state | {"number": number, "versions": versions, "sources": state["sources"] | {batch[0]: batch[1]}})
        draft = self._place(f"_drafts/{number}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._place("_commits"))
        if not self._fs.rename(draft, self._place(f"_commits/{number}.json")):
            raise RuntimeError(f"commit {number} of {self.path} failed: is there another writer?")

    # -- reading --------------------------------------------------------
    def _bucket(self) -> Column:
        part = F.pmod(F.xxhash64(*self.schema.names), F.lit(self.spread)) if self.spread > 1 else F.lit(0)
        return F.pmod(F.xxhash64(self.key) + part, F.lit(self.buckets)).cast("int")

    def _load(self, versions: dict[str, list[int]]) -> DataFrame:
        folders = [f"{self.path}/data/v={v}/bucket={b}" for b, vs in versions.items() for v in vs]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All rows as of the newest commit."""
        return self._load(self.last()["versions"])

    def _buckets_of(self, keys: DataFrame) -> set[str]:
        """Bucket numbers in which the keys may have rows: at most ``buckets`` of them."""
        first = [r.b for r in keys.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("b"))
                 .distinct().collect()]
        return {str((b + s) % self.buckets) for b in first for s in range(self.spread)}

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is among ``keys`` (one column, named like the key); only their buckets are read."""
        hit = self._buckets_of(keys)
        return self._load({b: v for b, v in self.last()["versions"].items() if b in hit}).join(
            keys.distinct(), self.key, "left_semi")

    # -- writing --------------------------------------------------------
    def _write(self, rows: DataFrame, number: int) -> list[str]:
        """Write rows by bucket as commit ``number``; returns the buckets that got a file.  A large
        bucket is dealt to several tasks, a file each, so that few buckets do not mean few tasks."""
        out = f"data/v={number}"
        self._fs.delete(self._place(out), True)  # what an attempt without a commit has left
        (rows.select(*self.schema.names, self._bucket().alias("bucket"))
         .hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{out}"))
        return [n[7:] for n in self._names(out) if n.startswith("bucket=")]

    def append(self, rows: DataFrame, batch: Batch) -> None:
        """Add rows that are not there yet, as a set: an equal row is written once."""
        state = self.last()
        if state["sources"].get(batch[0], -1) >= batch[1]:
            return
        rows = reliable_checkpoint(rows.select(*self.schema.names).distinct())
        there = self.lookup(rows.select(self.key))
        same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in self.schema.names])
        self._add(rows.alias("n").join(there.alias("o"), same, "left_anti"), state, batch)

    def insert_ignore(self, rows: DataFrame, batch: Batch) -> None:
        """Add rows of keys that are not there; of several new rows of a key the least is kept."""
        state = self.last()
        if state["sources"].get(batch[0], -1) >= batch[1]:
            return
        one = reliable_checkpoint(rows.groupBy(self.key).agg(F.min(F.struct(*self.schema.names)).alias("_r")).select("_r.*"))
        self._add(one.join(self.lookup(one.select(self.key)).select(self.key), self.key, "left_anti"), state, batch)

    def _add(self, rows: DataFrame, state: dict, batch: Batch) -> None:
        number, versions = state["number"] + 1, state["versions"]
        written = self._write(rows, number)
        self._commit(state, batch, versions | {b: [*versions.get(b, []), number] for b in written})

    def merge(self, rows: DataFrame, batch: Batch, keep: Callable[[Column, Column, str], Column] | None = None,
              ignore: tuple[str, ...] = ()) -> None:
        """Replace or add one row a key (keys not null); a bucket without a change is not rewritten.

        ``keep(old, new, column)`` gives the value where both rows are there (default: the
        new one).  Rows that differ in ``ignore`` columns only are no change.
        """
        state = self.last()
        if state["sources"].get(batch[0], -1) >= batch[1]:
            return
        keep = keep or (lambda old, new, column: new[column])
        rows = rows.select(*self.schema.names)
        versions = state["versions"]

        def with_old(new: DataFrame, how: str) -> DataFrame:
            hit = self._buckets_of(new.select(self.key))
            old = self._load({b: v for b, v in versions.items() if b in hit})
            return (old.select(F.col(self.key).alias("_ok"), F.struct(*self.schema.names).alias("_old"))
                    .join(new.select(F.col(self.key).alias("_nk"), F.struct(*self.schema.names).alias("_new")),
                          F.col("_ok") == F.col("_nk"), how))

        o, n = F.col("_old"), F.col("_new")
        differs = reduce(lambda a, b: a | b, [~o[c].eqNullSafe(n[c]) for c in self.schema.names if c not in ignore])
        changed = reliable_checkpoint(with_old(rows, "right").where(o.isNull() | differs).select("_new.*"))
        merged = with_old(changed, "full").select(*[
            F.when(o.isNull(), n[c]).when(n.isNull(), o[c]).otherwise(keep(o, n, c)).alias(c) for c in self.schema.names])
        written = self._write(merged, state["number"] + 1)
        self._commit(state, batch, versions | {b: [state["number"] + 1] for b in written})

    # -- house-keeping --------------------------------------------------
    def vacuum(self, keep_commits: int = 2) -> int:
        """Delete bucket folders that none of the newest commits lists; returns how many."""
        numbers = self._commits()
        used = {(v, b) for n in numbers[-keep_commits:] for b, vs in self._state(n)["versions"].items() for v in vs}
        gone = 0
        for n in numbers:
            for name in self._names(f"data/v={n}"):
                if name.startswith("bucket=") and (n, name[7:]) not in used:
                    self._fs.delete(self._place(f"data/v={n}/{name}"), True)
                    gone += 1
        return gone
