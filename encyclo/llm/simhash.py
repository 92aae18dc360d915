"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits.  The anchors are the words of a covering code: the
first-order Reed-Muller code of 16 bits (32 words, covering radius 6) in each
of four blocks, 2^20 anchors and covering radius 24 in all -- or, beyond
``FINE_FROM`` fingerprints, that of 8 bits (16 words, radius 2) in eight
blocks, 2^32 anchors.  Both give the same links; the finer one keeps the
groups small.

Two fingerprints at distance d or less have a midpoint at distance at most
ceil(d/2) from both, and the midpoint has a nearest anchor.  So a fingerprint
is replicated to the nearest anchor of every point within ceil(d/2) of it (all
of them lie within covering radius plus threshold), and all pairs within d
meet at an anchor, where they are compared.  Nearest anchors are those of the
blocks, so the replication works block by block from one small table.

Copies collapse to one fingerprint before the replication.  Links leave a task
as stars of local classes, not as pairs.  Anchors with more than
``GROUP_ROWS`` fingerprints are cut into tiles, each pair of tiles a group of
its own.

Texts that are null, empty or without words get fingerprint zero and are
linked like any other; repeated rows stay; a null doc_id never becomes a
component id unless a whole component has none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, map_batches, ragged, release, stage, white_space_map
from .components import components, merge_labels

SHINGLE = 4
MAX_BITS = 4
FINE_FROM = 1 << 24
GROUP_ROWS = 8192
BUFFER_ROWS = 1 << 19
SLICE_BYTES = 2 << 20  # of text at once: as shingles it takes some forty times that, in every worker


def fingerprints_of(words: Words, shingle: int) -> np.ndarray:
    """SimHash of each document: bit majority over the XXH64 (seed 42) of its shingles."""
    n_docs, n = len(words.doc) - 1, len(words.off) - 1
    out = np.zeros(n_docs, dtype=np.uint64)
    if not n:
        return out
    lens = np.diff(words.off)
    spaced = np.full(len(words.data) + n, 0x20, dtype=np.uint8)
    spaced[np.arange(len(words.data)) + np.repeat(np.arange(n), lens)] = words.data
    text = spaced.tobytes()
    begin = words.off[:-1] + np.arange(n)
    end = begin + lens
    size = np.diff(words.doc)
    count = np.where(size == 0, 0, np.maximum(size - shingle + 1, 1))
    first = ragged(words.doc[:-1], count)
    last = first + np.repeat(np.minimum(size, shingle) - 1, count)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(begin[first].tolist(), end[last].tolist())),
                    dtype=np.uint64, count=len(first))
    # bit counts: the eight bits of a byte spread over the eight bytes of a number, summed over runs of 255
    spread = np.zeros(256, dtype=np.uint64)
    for bit in range(8):
        spread |= ((np.arange(256, dtype=np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(8 * bit)
    runs = -(-count // 255)
    doc_at = np.cumsum(count) - count
    run_at = np.repeat(doc_at, runs) + 255 * ragged(np.zeros(n_docs, np.int64), runs)
    has = np.flatnonzero(count)
    doc_run = (np.cumsum(runs) - runs)[has]
    for byte in range(8):
        part = np.add.reduceat(spread[(h >> np.uint64(8 * byte)) & np.uint64(255)], run_at)
        for bit in range(8):
            ones = np.add.reduceat((part >> np.uint64(8 * bit)) & np.uint64(255), doc_run)
            out[has] |= (2 * ones.astype(np.int64) > count[has]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE,
                 keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` plus ``fp`` (the 64 bits as a long)."""
    def run(batch):
        w = Words(batch.column(batch.schema.get_field_index(text_col)), white_space_map())
        return {"fp": fingerprints_of(w, shingle).view(np.int64)}
    return map_batches(docs, run, T.StructType([T.StructField("fp", T.LongType())]), keep, SLICE_BYTES)


def code_words(bits: int) -> np.ndarray:
    """First-order Reed-Muller code: all affine functions of log2(bits) variables."""
    m = bits.bit_length() - 1
    x = np.arange(bits)
    words = []
    for a in range(2 * bits):
        value = np.full(bits, a >> m)
        for v in range(m):
            value = value ^ (((a >> v) & 1) * ((x >> v) & 1))
        words.append(int((value << x).sum()))
    return np.array(sorted(words), dtype=np.int64)


def nearest_table(bits: int, flips: int):
    """For each block value: nearest anchors of the points within ``flips`` bits,
    each with the fewest flips that reach it, as (offsets, anchors, costs)."""
    code = code_words(bits)
    values = np.arange(1 << bits, dtype=np.int64)
    home = np.empty(len(values), dtype=np.int64)
    for at in range(0, len(values), 4096):
        part = values[at:at + 4096]
        home[at:at + 4096] = np.bitwise_count(part[:, None] ^ code[None, :]).argmin(axis=1)
    reached = np.full((len(values), len(code)), flips + 1, dtype=np.int8)
    masks = [(0, 0)]
    frontier = [0]
    for f in range(1, flips + 1):
        frontier = sorted({m | (1 << b) for m in frontier for b in range(bits) if not m >> b & 1})
        masks += [(m, f) for m in frontier]
    for mask, f in reversed(masks):
        reached[values, home[values ^ mask]] = f
    rows, anchors = np.nonzero(reached <= flips)
    off = np.searchsorted(rows, np.arange(len(values) + 1))
    return off, anchors, reached[rows, anchors].astype(np.int64)


def anchors_of(fps: np.ndarray, table, bits: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors to which the fingerprints go."""
    off, homes, costs = table
    width = (2 * bits - 1).bit_length()
    row = np.arange(len(fps))
    anchor = np.zeros(len(fps), dtype=np.int64)
    cost = np.zeros(len(fps), dtype=np.int64)
    mask = np.uint64((1 << bits) - 1)
    for block in range(64 // bits):
        value = ((fps >> np.uint64(block * bits)) & mask).astype(np.int64)[row]
        n = off[value + 1] - off[value]
        at = ragged(off[value], n)
        total = np.repeat(cost, n) + costs[at]
        ok = total <= flips
        row, anchor, cost = np.repeat(row, n)[ok], (np.repeat(anchor, n)[ok] << width) | homes[at][ok], total[ok]
    return row, anchor


def near_pairs(group: np.ndarray, x: np.ndarray, side: np.ndarray, max_bits: int):
    """Index pairs within a group (rows sorted by group) at ``max_bits`` or fewer,
    in blocks; rows of different tile pairs are compared across sides only."""
    live = np.arange(len(x) - 1)
    shift = 1
    while len(live):
        live = live[live + shift < len(x)]
        live = live[group[live] == group[live + shift]]
        a, b = live, live + shift
        near = np.bitwise_count(x[a] ^ x[b]) <= max_bits
        near &= (side[a] < 0) | (side[a] != side[b])
        if near.any():
            yield a[near], b[near]
        shift += 1


def links(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS,
          bits: int | None = None) -> DataFrame:
    """``fps(fp)`` (distinct) -> links ``(a, b)`` whose classes are those of all
    pairs of fingerprints at ``max_bits`` or fewer."""
    spark = fps.sparkSession
    flips = -(-max_bits // 2)
    if bits is None:
        bits = 16 if fps.count() < FINE_FROM else 8
    table = spark.sparkContext.broadcast(nearest_table(bits, flips))  # 2^bits rows at most

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                row, anchor = anchors_of(part.view(np.uint64), table.value, bits, flips)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], names=["anchor", "fp"])

    sent = stage(fps.select("fp").mapInArrow(replicate, "anchor long, fp long"), "anchors")
    hot = sent.groupBy("anchor").count().where(F.col("count") > group_rows)
    cuts = F.ceil(F.col("count") / (group_rows // 2))
    tiled = (sent.join(hot, "anchor", "left")
             .withColumn("side", F.when(F.col("count").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("fp"), cuts)))
             .withColumn("other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1).cast("long")))
                                            .otherwise(F.sequence(F.lit(0).cast("long"), cuts - 1))))
             .select("anchor", F.least("side", "other").alias("t0"), F.greatest("side", "other").alias("t1"),
                     # within a tile all pairs are compared, else those across
                     F.when(F.col("side") == F.col("other"), F.lit(-1)).otherwise(F.col("side")).cast("long").alias("side"),
                     "fp")
             .repartition("anchor", "t0", "t1").sortWithinPartitions("anchor", "t0", "t1"))

    def compare(batches):
        def done(cols):
            anchor, t0, t1, side, fp = cols
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])
            nodes, at = np.unique(fp, return_inverse=True)
            labels = np.arange(len(nodes))
            for i, j in near_pairs(np.cumsum(new), fp.view(np.uint64), side, max_bits):
                labels = merge_labels(labels, at[i], at[j])
            member = np.flatnonzero(labels != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes[member]), pa.array(nodes[labels[member]])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            if cut:
                yield done([c[:cut] for c in cols])
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if rows:
            yield done([np.concatenate(c) for c in zip(*held)])
        del held
        release()

    return tiled.mapInArrow(compare, "a long, b long")


def _of_fingerprints(marked: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component) of all fingerprints; component is a fingerprint itself."""
    distinct = stage(marked.select("fp").distinct(), "distinct-fp")
    part = components(links(distinct, max_bits))
    return distinct.join(part, distinct["fp"] == part["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)`` of each document; component_id is the smallest id reachable."""
    marked = stage(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")),
                                "_t", shingle, keep=["doc_id"]), "fingerprints")
    part = _of_fingerprints(marked, max_bits)
    low = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    ids = part.join(low, "fp").groupBy("component").agg(F.min("low").alias("component_id"))
    part = part.join(ids, "component").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(part, marked["fp"] == part["_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (ids that are null
    come last; of one id, that of the smallest text hash)."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    marked = stage(fingerprints(keyed, "_t", shingle, keep=["_id", "_h"]), "fingerprints")
    part = _of_fingerprints(marked, max_bits)
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    first = (marked.groupBy("fp").agg(F.min(rank).alias("first")).join(part, "fp")
             .groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.h"))
    kept = docs.withColumn("_key", F.xxhash64(text_col)).join(
        first, docs[id_col].eqNullSafe(first["id"]) & (F.col("_key") == first["h"]), "left_semi")
    return kept.dropDuplicates([id_col, "_key"]).drop("_key")  # rows repeated whole
