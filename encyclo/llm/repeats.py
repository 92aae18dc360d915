"""Removal of repeated byte strings by difference-cover suffix sorting, bucket by bucket.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus.  The suffixes (positions with at least LENGTH
bytes left) are dealt into buckets by content: each suffix's first LENGTH bytes
have an anchor, the 64-byte gram of least hash, and contain the 232 bytes
beginning or ending with it; these name the bucket.  Equal strings share their
bucket, and a bucket with one member needs no sorting and is never sent.

A bucket's suffixes are sorted with bounded memory: the positions of a
difference cover modulo 32 get ranks first (by their first 32 bytes, doubled to
256); suffixes are sorted by their first 32 bytes, and longer ties are resolved
by the ranks of the two sample positions that the cover guarantees at equal
distance from both, and by the last bytes.  Small buckets are sorted together
in blocks of ``BLOCK_BYTES``.

Copies of a whole text count as one text that is removed if it has LENGTH
bytes.  A bucket of more than ``HOT_MEMBERS`` members is not gathered: its
strings are counted by 128-bit hash, pre-aggregated in the tasks.

Texts are UTF-8 bytes, null is empty; shorter texts lose nothing; matches never
cross documents; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_buffer

LENGTH = 400
GRAM = 64
COVER = 32
HOT_MEMBERS = 16_384
BLOCK_BYTES = 4 << 20
SLICE = 2 << 20
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so invertible modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substring of a buffer."""

    def __init__(self, raw: np.ndarray, base: int = BASE[0]):
        n = len(raw)
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[begin + length] - self.sums[begin]) * self.inverse[begin])


def members(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, first, last, key): ranges of suffixes of one bucket, in bytes of the document."""
    n = len(raw)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    hashes = Hashes(raw)
    places = n - gram + 1
    least = (hashes.of(np.arange(places), gram) & ~np.uint64((1 << 32) - 1)) | np.arange(places, dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:-(width - span)], least[width - span:])
    anchor = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    size = np.diff(off)
    whole = np.flatnonzero(np.arange(n - length + 1) + length <= np.repeat(off[1:], size)[:n - length + 1])
    if not len(whole):
        return none
    c = anchor[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, c = whole[at], np.append(whole[at[1:] - 1], whole[-1]), c[at]
    half = (length - gram) // 2
    before = np.flatnonzero(first <= c - half)  # the 232 bytes that end with the gram
    after = np.flatnonzero(last > c - half)     # the 232 bytes that begin with it
    begin = np.concatenate([first[before], np.maximum(first[after], c[after] - half + 1)])
    end = np.concatenate([np.minimum(last[before], c[before] - half), last[after]])
    key = np.concatenate([hashes.of(c[before] - half, half + gram), mix(hashes.of(c[after], half + gram) + np.uint64(1))])
    doc = np.searchsorted(off, begin, side="right") - 1
    return doc, begin - off[doc], end - off[doc], key


# ---- sorting a bucket ---------------------------------------------------------

def difference_cover(v: int) -> list[int]:
    """Residues among which every difference modulo ``v`` occurs, picked greedily."""
    cover, seen = [0, 1], {0, 1, v - 1}
    while len(seen) < v:
        def gain(x):
            return len(({(x - d) % v for d in cover} | {(d - x) % v for d in cover}) - seen)
        best = max((x for x in range(v) if x not in cover), key=lambda x: (gain(x), -x))
        seen |= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return sorted(cover)


def distances(v: int, cover: list[int]) -> np.ndarray:
    """For residues a, b: the least d with a + d and b + d both in the cover."""
    has = np.zeros(v, dtype=bool)
    has[cover] = True
    out = np.full((v, v), -1, dtype=np.int64)
    r = np.arange(v)
    for d in range(v - 1, -1, -1):
        out[has[(r + d) % v][:, None] & has[(r + d) % v][None, :]] = d
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number, the first byte highest (zeros after the end)."""
    n = len(text)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out[:n - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def dense_ranks(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row given the sorted order; equal rows share theirs."""
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sample_ranks(words: np.ndarray, v: int, cover: list[int], depth: int) -> np.ndarray:
    """Ranks of the cover's positions by their first ``depth`` bytes; -1 elsewhere."""
    n = len(words)
    has = np.zeros(v, dtype=bool)
    has[cover] = True
    sample = np.flatnonzero(has[np.arange(n) % v])
    padded = np.append(words, np.zeros(v, dtype=np.uint64))
    columns = [padded[sample + k] for k in range(0, v, 8)]
    rank = np.full(n + depth, -1, dtype=np.int64)
    rank[sample] = dense_ranks(np.lexsort(columns[::-1]), columns)
    reach = v
    while reach < depth:  # positions a multiple of v further on are in the cover too
        pair = (rank[sample] + 1) * (n + 1) + rank[sample + reach] + 1
        rank[sample] = dense_ranks(np.argsort(pair, kind="stable"), [pair])
        reach *= 2
    return rank


_COVER = difference_cover(COVER)
_APART = distances(COVER, _COVER)


def string_classes(text: np.ndarray, suffix: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of each suffix position: equal where the first ``length`` bytes are equal.

    ``length`` is 384 to 400 here: ranks reach 256 bytes, taken twice 96 apart.
    """
    depth, v, step = 256, COVER, 96
    words = words_at(text)
    rank = sample_ranks(words, v, _COVER, depth)
    head = [words[suffix + k] for k in range(0, v, 8)]
    order = np.lexsort(head[::-1])
    group = dense_ranks(order, head)
    result = np.empty(len(suffix), dtype=np.int64)
    todo = np.arange(len(suffix))
    made = 0
    while len(todo):
        # one pivot per tie group; everything is compared with it at their common cover distance
        order = np.argsort(group[todo], kind="stable")
        todo = todo[order]
        g = group[todo]
        new = np.ones(len(todo), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        number = np.cumsum(new) - 1
        i, pivot = suffix[todo], suffix[todo[np.flatnonzero(new)]][number]
        d = _APART[i % v, pivot % v]
        sign = np.zeros(len(todo), dtype=np.int64)
        for a, b in ((rank[i + d], rank[pivot + d]), (rank[i + d + step], rank[pivot + d + step])):
            sign = np.where(sign == 0, np.sign(a - b), sign)
        tie = np.flatnonzero((sign == 0) & (i != pivot))
        for k in range(step + depth, length, 8):
            k = min(k, length - 8)
            a, b = words[i[tie] + k], words[pivot[tie] + k]
            sign[tie] = np.where(a == b, 0, np.where(a < b, -1, 1))
            tie = tie[a == b]
        same = sign == 0
        result[todo[same]] = made + number[same]
        made += int(number[-1]) + 1
        group[todo] = 3 * number + sign
        todo = todo[~same]
    return result


def repeated_spans(bodies: list[bytes], length: int = LENGTH):
    """(body, begin, end) of the bytes of each body in strings that start twice in the bodies."""
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    count = np.maximum(size - length + 1, 0)
    body = np.repeat(np.arange(len(bodies)), count)
    local = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    suffix = (np.cumsum(size) - size)[body] + local
    if not len(suffix):
        return (np.zeros(0, np.int64),) * 3
    label = string_classes(text, suffix, length)
    hit = np.flatnonzero(np.bincount(label)[label] > 1)
    return covered(body[hit], local[hit], length)


def covered(owner: np.ndarray, start: np.ndarray, length: int):
    """Runs of consecutive starts of one owner, as (owner, begin, end) of the bytes they cover."""
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], start[at], start[last] + length


# ---- the corpus ---------------------------------------------------------------

def spans(docs: DataFrame, length: int = LENGTH, hot_members: int = HOT_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``docs(id, text)`` -> (rows, found).

    rows: (id, digest, n_bytes, sha) of every row; found: (digest, text, spans) of
    each distinct text with repeated strings, spans as [begin, end, ...] of bytes.
    """
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sha = F.sha2(binary, 256)
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.substring(F.unhex(sha), F.lit(1), F.lit(16)).alias("digest"))
    rows = stage(docs.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")

    def cut(batches):
        for b in slices(batches, SLICE):
            raw, off = text_buffer(b.column(0))
            doc, first, last, key = members(raw, off, length)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), b.column(1).take(pa.array(doc)), pa.array(first.astype(np.int32)),
                     pa.array(last.astype(np.int32))], names=["key", "digest", "first", "last"])

    every = docs.select("text", "digest").mapInArrow(cut, "key long, digest binary, first int, last int")
    # equal keys at one place are copies of a text; two places make a bucket
    place = F.xxhash64("digest", "first")
    buckets = (every.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
               .where("a <> b").select("key", (F.col("n") > hot_members).alias("hot")))
    # copies of a text meet in the set of their ranges, combined before the shuffle
    of_text = every.join(buckets, "key").groupBy("digest").agg(F.collect_set(F.struct("key", "hot", "first", "last")).alias("ranges"))
    one = rows.groupBy("digest").agg(F.min("id").alias("low"))
    of_text = of_text.join(one, "digest").select(F.col("digest").alias("d"), "low", "ranges")
    with_text = stage(docs.join(of_text, (docs["digest"] == of_text["d"]) & docs["id"].eqNullSafe(of_text["low"]))
                      .select("digest", "text", "ranges").dropDuplicates(["digest"]), "repeat-candidates")

    def bodies(batches):
        for b in slices(batches, SLICE):
            raw, off = text_buffer(b.column(1))
            data = raw.tobytes()
            r = b.column(2)
            at = r.offsets.to_numpy()
            at = at - at[0]
            flat = r.flatten()
            key, hot, first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            cold = np.flatnonzero(~hot.astype(bool))
            begin = off[doc] + first
            none = lambda n, t: pa.nulls(n, t)
            if len(cold):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[cold]), b.column(0).take(pa.array(doc[cold])), pa.array(first[cold].astype(np.int32)),
                     pa.array([data[x:y] for x, y in zip(begin[cold].tolist(), (off[doc[cold]] + last[cold] + length).tolist())], pa.binary()),
                     none(len(cold), pa.int64()), none(len(cold), pa.int64())],
                    names=["key", "digest", "first", "body", "h0", "h1"])
            warm = np.flatnonzero(hot.astype(bool))
            if len(warm):
                h0, h1 = Hashes(raw), Hashes(raw, BASE[1])
                for k in range(0, len(warm), 4096):
                    w = warm[k:k + 4096]
                    n = (last[w] - first[w] + 1).astype(np.int64)
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    p = np.repeat(begin[w], n) + step
                    yield pa.RecordBatch.from_arrays(
                        [none(len(p), pa.int64()), b.column(0).take(pa.array(np.repeat(doc[w], n))),
                         pa.array((np.repeat(first[w], n) + step).astype(np.int32)), none(len(p), pa.binary()),
                         pa.array(h0.of(p, length).view(np.int64)), pa.array(h1.of(p, length).view(np.int64))],
                        names=["key", "digest", "first", "body", "h0", "h1"])

    sent = with_text.mapInArrow(bodies, "key long, digest binary, first int, body binary, h0 long, h1 long")

    def sort_buckets(batches):
        def done(keys, digests, firsts, texts):
            # copies of a row may have sent a body twice
            own = [k for k in range(len(keys)) if not k or (keys[k], digests[k], firsts[k]) != (keys[k - 1], digests[k - 1], firsts[k - 1])]
            body, begin, end = repeated_spans([texts[k] for k in own], length)
            if len(body):
                row = [own[k] for k in body.tolist()]
                shift = np.array([firsts[k] for k in row], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[k] for k in row], pa.binary()), pa.array((begin + shift).astype(np.int32)),
                     pa.array((end + shift).astype(np.int32))], names=["digest", "begin", "end"])

        keys, digests, firsts, texts, size = [], [], [], [], 0
        for b in batches:
            for k, d, f, t in zip(*(b.column(c).to_pylist() for c in range(4))):
                if size >= BLOCK_BYTES and k != keys[-1]:
                    yield from done(keys, digests, firsts, texts)
                    keys, digests, firsts, texts, size = [], [], [], [], 0
                keys.append(k)
                digests.append(d)
                firsts.append(f)
                texts.append(t)
                size += len(t)
        if keys:
            yield from done(keys, digests, firsts, texts)

    sorted_ = (sent.where("key is not null").select("key", "digest", "first", "body").repartition("key")
               .sortWithinPartitions("key", "digest", "first").mapInArrow(sort_buckets, "digest binary, begin int, end int"))
    strings = sent.where("h0 is not null").select("h0", "h1", "digest", "first")
    twice = (strings.groupBy("h0", "h1").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
             .select(F.col("h0").alias("x0"), F.col("h1").alias("x1")))
    counted = (strings.join(twice, (F.col("h0") == F.col("x0")) & (F.col("h1") == F.col("x1")))
               .select("digest", F.col("first").alias("begin"), (F.col("first") + length).alias("end")))
    pieces = sorted_.unionByName(counted).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("pieces"))
    merged = F.aggregate("pieces", F.array().cast("array<int>"), lambda acc, p: F.when(
        (F.size(acc) > 0) & (p["begin"] <= F.element_at(acc, -1)),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["end"]))))
        .otherwise(F.concat(acc, F.array(p["begin"], p["end"]))))
    found = pieces.select(F.col("digest").alias("d"), merged.alias("spans"))
    return rows, with_text.join(found, with_text["digest"] == found["d"]).select("digest", "text", "spans")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            hot_members: int = HOT_MEMBERS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs``."""
    import hashlib
    rows, found = spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), length, hot_members)

    def digest(batches):
        for b in batches:
            made = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, at, h = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                for x, y in zip(cuts[::2], cuts[1::2]):
                    h.update(raw[at:x])
                    at = y
                h.update(raw[at:])
                made.append((sum(cuts[1::2]) - sum(cuts[::2]), len(cuts) // 2, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(
                zip(*made) if made else ((), (), ()), (pa.int64(), pa.int64(), pa.string())))],
                names=["_d", "_removed", "_spans", "_sha"])

    part = found.mapInArrow(digest, "_d binary, _removed long, _spans long, _sha string")
    copies = rows.groupBy(F.col("digest").alias("_c")).agg(F.count("*").alias("_n"))
    part = copies.where((F.col("_n") > 1)).join(part.withColumnRenamed("_d", "_c"), "_c", "full")
    whole = (F.coalesce("_n", F.lit(1)) > 1) & (F.col("n_bytes") >= length)
    return (rows.join(part, F.col("digest") == F.col("_c"), "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256")))
