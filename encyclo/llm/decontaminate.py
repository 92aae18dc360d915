"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of the benchmark items (an item
of fewer words is one window).  The alphabet is the word: per pattern length
there is one search table with

* a shift table over blocks of two words: how far the search may skip when the
  block under the cursor cannot end an occurrence,
* buckets by the hash of a window's last block, and in them by its first word,
* direct comparison of the whole window against the text.

A window of 13 words lets the search skip 12 words at almost every step.  The
benchmark is a stated query set: its windows go to the tasks in blocks of at
most ``BLOCK_WINDOWS``, one pass over the documents per block, so the
broadcast is bounded whatever the benchmark's size; the documents are never
shuffled.

Nulls, empty texts and texts without words have no words and no hits; an item
without words has no window; an item with a null id counts its hits but is not
listed.  Repeated documents each get their row, repeated items count once by
id.  Columns of the documents whose names clash with the new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, alnum_map, map_batches, stage

WINDOW = 13
BLOCK_WINDOWS = 500_000

STATE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
    T.StructField("item_ids", T.ArrayType(T.LongType()))])


class WuManber:
    """Search for patterns (tuples of word numbers) of one length, by its shift table and buckets.

    The tables are plain dictionaries: these are what goes out to the tasks.
    """

    def __init__(self, length: int, shift: dict, bucket: dict):
        self.length, self.block, self.shift, self.bucket = length, min(2, length), shift, bucket
        self.default = length - self.block + 1

    @staticmethod
    def tables(patterns: dict[tuple, list], length: int) -> tuple[int, dict, dict]:
        block = min(2, length)
        shift: dict = {}
        bucket: dict = {}
        for p, owners in patterns.items():
            for end in range(block, length + 1):
                b = p[end - block:end]
                shift[b] = min(shift.get(b, length - block + 1), length - end)
            bucket.setdefault(p[-block:], {}).setdefault(p[0], []).append((p, owners))
        return length, shift, bucket

    def find(self, words: tuple):
        """(start, owners) of every occurrence of a pattern in ``words``."""
        m, k, shift, default = self.length, self.block, self.shift, self.default
        i, n = m, len(words)
        while i <= n:
            step = shift.get(words[i - k:i], default)
            if step:
                i += step
                continue
            for p, owners in self.bucket[words[i - k:i]].get(words[i - m], ()):
                if words[i - m:i] == p:
                    yield i - m, owners
            i += 1


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window and item: ``words`` (array of bytes), ``item_id``."""
    schema = T.StructType([T.StructField("windows", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def cut(batch):
        w = Words(batch.column(1), alnum_map())
        words = w.arrow().to_pylist()
        out = []
        for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist()):
            size = min(WINDOW, b - a)
            out.append([words[i:i + size] for i in range(a, b - size + 1)] if size else [])
        return {"windows": out}

    return (map_batches(benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("_t")),
                        cut, schema, keep=["item_id"])
            .select("item_id", F.explode("windows").alias("words")).distinct())


def window_blocks(windows: DataFrame, size: int = BLOCK_WINDOWS):
    """Lists of at most ``size`` (words, item) rows, one list in memory at a time."""
    block = []
    for row in windows.toLocalIterator():
        block.append((tuple(bytes(w) for w in row["words"]), row["item_id"]))
        if len(block) == size:
            yield block
            block = []
    yield block


def search_tables(block: list):
    vocabulary: dict = {}
    by_length: dict = {}
    for words, item in block:
        p = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words)
        by_length.setdefault(len(p), {}).setdefault(p, []).append(item)
    return list(vocabulary), [WuManber.tables(p, m) for m, p in sorted(by_length.items())]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
         id_col: str = "item_id", item_text_col: str = "text",
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` plus n_words, hit_spans ([start, end, ...] in words, disjoint,
    ascending) and item_ids (ascending, distinct) of the windows found."""
    import pyarrow as pa
    sc = docs.sparkSession.sparkContext
    out, first = docs, True
    for block in window_blocks(item_windows(benchmark, id_col, item_text_col), block_windows):
        if not (block or first):
            continue
        tables = sc.broadcast(search_tables(block))
        if not first:
            out = stage(out, "decontaminate")

        def search(batch, tables=tables, first=first):
            vocabulary, searches = tables.value
            searches = [WuManber(*t) for t in searches]
            w = Words(batch.column(batch.schema.get_field_index(text_col)), alnum_map())
            if vocabulary:
                codes = pc.index_in(w.arrow(), value_set=pa.array(vocabulary, pa.large_binary()))
                codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
            spans, items = [], []
            old_spans = None if first else batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            old_items = None if first else batch.column(batch.schema.get_field_index("item_ids")).to_pylist()
            for d, (a, b) in enumerate(zip(w.doc[:-1].tolist(), w.doc[1:].tolist())):
                found = [] if first else list(zip(old_spans[d][::2], old_spans[d][1::2]))
                own = set() if first else set(old_items[d])
                if vocabulary and b > a:
                    words = tuple(codes[a:b].tolist())
                    for s in searches:
                        for at, owners in s.find(words):
                            found.append((at, at + s.length))
                            own.update(owners)
                flat: list[int] = []
                for x, y in sorted(found):
                    if flat and x <= flat[-1]:
                        flat[-1] = max(flat[-1], y)
                    else:
                        flat += [x, y]
                spans.append(flat)
                items.append(sorted(x for x in own if x is not None))
            return {"n_words": np.diff(w.doc), "hit_spans": spans, "item_ids": items}

        out = map_batches(out, search, STATE)
        first = False
    return out


def verdict(marked: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (some hit, and at least a twentieth of the words)."""
    spans = F.col("hit_spans")
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    return (marked.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their own columns only."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return verdict(mark(packed, benchmark, "_text")).where(~F.col("contaminated")).select("_row.*")


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in ids)).encode()).hexdigest()
