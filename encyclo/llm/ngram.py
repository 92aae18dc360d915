"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model interpolates bigrams with the smoothed unigram distribution
(Dirichlet prior of weight ``PRIOR``)::

    P1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | h)  = (c(h w) + PRIOR * P1(w)) / (c(h) + PRIOR)

over words, an end of text, and a start as the first word's context; it sums to
one over the known words and the unknown one.

The trie is dealt into shards by hash of (context, word), so neither a frequent
word nor a frequent pair gathers in one of them.  In a shard the contexts are an
Elias-Fano sequence, so are the pointers to each context's successors, and so
are the successors, made monotone by an offset per context; their smoothed
probabilities are quantised to 16 bits in log space.  The levels are written to
files and memory-mapped, and a query (context, word) is answered by a successor
search for the context and one for the word relative to the context's range.

Words are numbered by descending count, so the count of a word follows from its
number and a table of the distinct counts (at most sqrt(2 N) of them), the only
thing that every task gets.  Texts are cut into blocks; a
block sends each distinct word and each distinct pair once, with its training
count, and gets numbers and log probabilities back.

Null and empty texts have the end token only.  Rows whose ``train`` is null or
false are scored but teach nothing; without training rows every probability is
the smoothed one.  Repeated rows count and are scored each; an empty table gives
no rows.  The blocks must come out the same when a task is repeated, so the rows
should be read from files (``common.stage`` does that).
"""

from __future__ import annotations

import os
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, release, slices, stage, white_space_map

PRIOR = 300.0
ADDED = 0.1
BLOCK_BYTES = 5 << 20
SHARD_TOKENS = 750_000
FLOOR = -16.0  # of log10 probabilities; 16 bits over this range are steps of 0.00025
START = 0


# ---- Elias-Fano sequences -----------------------------------------------------

_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    _at = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, :len(_at)] = _at


class EliasFano:
    """Monotone sequence of n numbers: low bits packed, high bits in unary.

    The arrays may be memory-mapped; all operations take arrays of queries.
    """

    PARTS = ("low", "high", "ones")

    def __init__(self, arrays: dict, n: int, width: int):
        self.a, self.n, self.width = arrays, n, width

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros(n * width, dtype=np.uint8)
        for bit in range(width):
            low[bit::width] = (v >> np.uint64(bit)) & np.uint64(1)
        high_at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(high_at[-1]) + 1 if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        high[high_at] = 1
        words = np.packbits(high, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words.view(np.uint64)).astype(np.int64))])
        return cls({"low": np.concatenate([np.packbits(low, bitorder="little"), np.zeros(9, np.uint8)]), "high": words, "ones": ones}, n, width)

    def _select(self, k: np.ndarray, cumulated: np.ndarray, flip: int) -> np.ndarray:
        """Position of the k-th (from 0) set bit, of the inverted bits if ``flip``."""
        word = np.searchsorted(cumulated, k, side="right") - 1
        left = k - cumulated[word]
        octets = self.a["high"].reshape(-1, 8)[word] ^ np.uint8(flip)
        count = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (count <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        before = np.where(octet > 0, count[rows, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _SELECT[octets[rows, octet], left - before]

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.a["ones"], 0) - i
        if not self.width:
            return high
        bit = i * self.width
        at, shift = bit >> 3, (bit & 7).astype(np.uint64)
        value = np.zeros(len(i), dtype=np.uint64)
        for k in range(8):
            value |= self.a["low"][at + k].astype(np.uint64) << np.uint64(8 * k)
        value >>= shift
        if self.width > 57:
            value |= np.where(shift > 0, self.a["low"][at + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, 1)), 0).astype(np.uint64)
        return (high << self.width) | (value & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is at least x (n if there is none)."""
        out = np.full(len(x), self.n, dtype=np.int64)
        if not self.n:
            return out
        zeros = np.arange(len(self.a["ones"])) * 64 - self.a["ones"]
        high = x >> self.width

        def begin(h):
            """Index of the first number whose high part is h or more: it comes after the h-th zero."""
            at = np.full(len(h), self.n, dtype=np.int64)
            at[h <= 0] = 0
            some = np.flatnonzero((h > 0) & (h <= zeros[-1]))
            at[some] = np.minimum(self._select(h[some] - 1, zeros, 0xFF) - (h[some] - 1), self.n)
            return at

        low, until = begin(high), begin(high + 1)
        out[:] = until
        todo = np.flatnonzero(low < until)
        low, until = low[todo], until[todo]
        while len(todo):
            mid = (low + until) >> 1
            reached = self.get(mid) >= x[todo]
            until = np.where(reached, mid, until)
            low = np.where(reached, low, mid + 1)
            out[todo] = until
            open_ = low < until
            todo, low, until = todo[open_], low[open_], until[open_]
        return out


class Trie:
    """One shard: contexts -> successors -> quantised log probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, span: int):
        self.contexts, self.pointers, self.successors, self.codes, self.span = contexts, pointers, successors, codes, span

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_prob: np.ndarray) -> "Trie":
        """From pairs sorted by context and word."""
        new = np.ones(len(context), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        at = np.flatnonzero(new)
        span = int(word.max()) + 1 if len(word) else 1
        # relative to its context: each range of successors starts where the one before may end
        relative = word + np.cumsum(new).astype(np.int64) * span - span
        return cls(EliasFano.of(context[at]), EliasFano.of(np.append(at, len(context))), EliasFano.of(relative), quantised(log_prob), span)

    def save(self, folder: str) -> "Trie":
        """Writes the levels to files and returns the trie that maps them."""
        def mapped(name, array):
            path = os.path.join(folder, name)
            array.tofile(path)
            return np.memmap(path, dtype=array.dtype, mode="r", shape=array.shape) if array.size else array

        levels = {}
        for name in ("contexts", "pointers", "successors"):
            e = getattr(self, name)
            levels[name] = EliasFano({p: mapped(f"{name}.{p}", e.a[p]) for p in EliasFano.PARTS}, e.n, e.width)
        return Trie(levels["contexts"], levels["pointers"], levels["successors"], mapped("codes", self.codes), self.span)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where the trie does not have it."""
        out = np.full(len(context), -1, dtype=np.int64)
        if not self.contexts.n:
            return out
        c = self.contexts.successor(context)
        ok = np.flatnonzero(c < self.contexts.n)
        ok = ok[self.contexts.get(c[ok]) == context[ok]]
        ok = ok[word[ok] < self.span]
        target = c[ok] * self.span + word[ok]
        s = self.successors.successor(target)
        inside = s < self.pointers.get(c[ok] + 1)
        ok, s, target = ok[inside], s[inside], target[inside]
        hit = self.successors.get(s) == target
        out[ok[hit]] = s[hit]
        return out


def quantised(log_prob: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log_prob / FLOOR, 0, 1) * 65535).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / 65535 * FLOOR


# ---- blocks and shards ----------------------------------------------------------

def press(**arrays) -> bytes:
    """Arrays packed small: bytes of equal weight together."""
    import zstandard
    flat = {k: (v.dtype.str, len(v), np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes())
            if isinstance(v, np.ndarray) else v for k, v in arrays.items()}
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(flat))


def unpress(data: bytes) -> dict:
    import zstandard
    flat = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {k: np.ascontiguousarray(np.frombuffer(v[2], np.uint8).reshape(-1, v[1]).T).view(v[0]).ravel()
            if isinstance(v, tuple) else v for k, v in flat.items()}


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) & np.uint64(0x7FFFFFFFFFFFFFFF)


def _read_blocks(docs: DataFrame, block_bytes: int, make, schema: str) -> DataFrame:
    """``make(block, ids, train, sizes, codes, words)`` of each block of ``docs(id, text, train)``.

    sizes are tokens per document, codes number the block's distinct words;
    word 0 is the end of text, the empty word.
    """
    def run(batches):
        part = TaskContext.get().partitionId() << 24
        held, size, seq = [], 0, 0

        def emit():
            every = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
            words = every.chunk(0).dictionary
            codes, sizes = [], []
            for k, (_, doc, _, _) in enumerate(held):
                n = np.diff(doc)
                sizes.append(n + 1)
                codes.append(np.insert(every.chunk(k).indices.to_numpy().astype(np.int64) + 1, doc[1:], 0))
            ids = pa.concat_arrays([h[2] for h in held])
            train = np.concatenate([h[3] for h in held])
            yield from make(part + seq, ids, train, np.concatenate(sizes), np.concatenate(codes), words)

        for batch in slices(batches, 2 << 20):
            w = Words(batch.column(1), white_space_map())
            held.append((w.arrow().dictionary_encode(), w.doc, batch.column(0),
                         batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)))
            size += batch.nbytes
            if size >= block_bytes:
                yield from emit()
                held, size, seq = [], 0, seq + 1
        if held:
            yield from emit()

    return docs.select("id", "text", "train").mapInArrow(run, schema)


def _row(**values):
    types = {"block": pa.int64(), "shard": pa.int64(), "payload": pa.binary(), "n": pa.int64(), "v": pa.int64(), "ends": pa.int64(),
             "counts": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([x], types[k]) for k, x in values.items()], names=list(values))


def word_shards(words: pa.Array, n_shards: int) -> np.ndarray:
    import zlib
    return np.fromiter((zlib.crc32(w) for w in [b"", *words.to_pylist()]), np.int64, len(words) + 1) % n_shards


def score(docs: DataFrame, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``docs(id, text, train)`` -> (id, train, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType.simpleString()
    # tokens are at most the bytes over two: enough shards, whatever the text
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 6)).first()[0] or 0
    n_shards = int(max(1, -(-size // (6 * shard_tokens))))

    # level one: words
    def send_words(block, ids, train, sizes, codes, words):
        taught = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words) + 1)
        shard = word_shards(words, n_shards)
        order = np.argsort(shard, kind="stable")
        every = [b"", *words.to_pylist()]
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield _row(block=block, shard=int(shard[at[0]]),
                       payload=press(words=b"\n".join([every[k] for k in at.tolist()]), taught=taught[at].astype(np.uint32)))

    def count_words(key, table):
        rows = [(b, unpress(p)) for b, p in zip(table.column("block").to_pylist(), table.column("payload").to_pylist())]
        number: dict[bytes, int] = {}
        places = [np.fromiter((number.setdefault(w, len(number)) for w in r["words"].split(b"\n")), np.int64) for _, r in rows]
        count = np.zeros(len(number), dtype=np.int64)
        for p, (_, r) in zip(places, rows):
            count += np.bincount(p, weights=r["taught"], minlength=len(number)).astype(np.int64)
        # within a count, words are numbered as they sort
        by_name = np.argsort(np.array(list(number), dtype=object), kind="stable")
        by_count = by_name[np.argsort(-count[by_name], kind="stable")]
        first = np.searchsorted(-count[by_count], -count[by_count], side="left")
        within = np.empty(len(number), dtype=np.int64)
        within[by_count] = np.arange(len(number)) - first
        out = [_row(block=b, shard=key[0].as_py(), payload=press(count=count[p], within=within[p].astype(np.uint32)),
                    n=None, v=None, ends=None, counts=None, sizes=None) for p, (b, _) in zip(places, rows)]
        classes, sizes = np.unique(count, return_counts=True)
        out.append(_row(block=None, shard=key[0].as_py(), payload=None, n=int(count.sum()), v=int((count > 0).sum()),
                        ends=int(count[number[b""]]) if b"" in number else 0, counts=classes.tolist(), sizes=sizes.tolist()))
        return pa.Table.from_batches(out)

    answers = stage(_read_blocks(docs, block_bytes, send_words, "block long, shard long, payload binary")
                    .groupBy("shard").applyInArrow(count_words, "block long, shard long, payload binary, n long, v long, ends long, counts array<long>, sizes array<long>"),
                    "word-numbers")
    totals = answers.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "ends")]).first()
    n_all, n_distinct, n_docs = totals["n"], totals["v"], totals["ends"]
    # the distinct counts, at most sqrt(2 N), and the numbers set aside for the words of each
    classes = (answers.where("block is null").select(F.explode(F.arrays_zip("counts", "sizes")).alias("x")).groupBy("x.counts")
               .agg(F.max("x.sizes").alias("most")).toPandas().sort_values("counts", ascending=False))
    most = classes["most"].to_numpy(np.int64)
    counts = spark.sparkContext.broadcast((classes["counts"].to_numpy(np.int64), 1 + n_shards * (np.cumsum(most) - most)))

    def log_base(count):
        return np.log10((count + ADDED) / (n_all + ADDED * (n_distinct + 1)))

    def count_of(number):
        """Training count of words by number; the start stands before every text."""
        table, start = counts.value
        return np.where(number == START, n_docs, table[np.maximum(np.searchsorted(start, number, side="right") - 1, 0)])

    # blocks get their words' numbers and ask for their pairs
    def send_codes(block, ids, train, sizes, codes, words):
        shard = word_shards(words, n_shards)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([press(train=train.astype(np.uint8), sizes=sizes.astype(np.uint32), codes=codes.astype(np.uint32), shard=shard.astype(np.uint32))], pa.binary())],
            names=["block", "ids", "payload"])

    coded = _read_blocks(docs, block_bytes, send_codes, f"block long, ids array<{id_type}>, payload binary")

    def send_pairs(state, answers):
        names = ["block", "shard", "ids", "payload"]
        list_type = state.schema.field("ids").type
        if not state.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "ids": pa.array([], list_type), "payload": pa.array([], pa.binary())})
        block = state.column("block")[0].as_py()
        s = unpress(state.column("payload")[0].as_py())
        train, sizes, codes, shard = s["train"].astype(bool), s["sizes"].astype(np.int64), s["codes"], s["shard"]
        count, number = np.zeros(len(shard), dtype=np.int64), np.zeros(len(shard), dtype=np.int64)
        table, start = counts.value
        for which, payload in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()):
            a = unpress(payload)
            at = np.flatnonzero(shard == which)
            count[at] = a["count"]
            number[at] = start[np.searchsorted(-table, -a["count"])] + a["within"].astype(np.int64) * n_shards + which
        ends = np.cumsum(sizes)
        begins = ends - sizes
        known = np.add.reduceat((count[codes] > 0).astype(np.int64), begins)
        base = np.add.reduceat(log_base(count)[codes], begins)
        context = np.empty(len(codes), dtype=np.int64)
        context[1:] = codes[:-1].astype(np.int64) + 1
        context[begins] = 0
        pair = context * len(shard) + codes
        distinct, first, which = np.unique(pair, return_index=True, return_inverse=True)
        taught = np.bincount(which[np.repeat(train, sizes)], minlength=len(distinct))
        numbers = np.concatenate([[START], number])
        c, w = numbers[distinct // len(shard)], number[distinct % len(shard)]
        to = (pair_hash(c, w) % np.uint64(n_shards)).astype(np.int64)
        # pairs by shard, then by context and word; tokens refer to pairs by order of appearance
        order = np.lexsort((w, c, to))
        rows = {n: [] for n in names}
        for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            for n, x in zip(names, (block, int(to[at[0]]), None, press(
                    context=np.diff(c[at], prepend=0), word=w[at], taught=taught[at].astype(np.uint32)))):
                rows[n].append(x)
        place = np.empty(len(distinct), dtype=np.int64)
        place[order] = np.arange(len(distinct))
        new = np.zeros(len(codes), dtype=bool)
        new[first] = True
        by_first = np.argsort(first)
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[by_first] = np.arange(len(distinct))
        rows["block"].append(block)
        rows["shard"].append(None)
        rows["payload"].append(press(train=s["train"], sizes=s["sizes"], known=known.astype(np.uint32), base=base,
                                     again=np.where(new, 0, rank[which] + 1).astype(np.uint32), place=place[by_first].astype(np.uint32)))
        release()
        lists = pa.concat_arrays([pa.nulls(len(rows["block"]) - 1, list_type), state.column("ids").combine_chunks().cast(list_type)])
        return pa.table({"block": pa.array(rows["block"], pa.int64()), "shard": pa.array(rows["shard"], pa.int64()),
                         "ids": lists, "payload": pa.array(rows["payload"], pa.binary())})

    numbered = answers.where("block is not null").select("block", "shard", "payload")
    asked = stage(coded.groupBy("block").cogroup(numbered.groupBy("block"))
                  .applyInArrow(send_pairs, f"block long, shard long, ids array<{id_type}>, payload binary"), "pairs")

    # level two: a shard's trie, built from its training pairs and asked for all
    def answer_pairs(key, table):
        blocks = table.column("block").to_pylist()
        rows = [unpress(p) for p in table.column("payload").to_pylist()]
        size = [len(r["word"]) for r in rows]
        context = np.concatenate([np.cumsum(r["context"]) for r in rows])
        word = np.concatenate([r["word"] for r in rows])
        taught = np.concatenate([r["taught"] for r in rows]).astype(np.int64)
        order = np.lexsort((word, context))
        context, word, taught = context[order], word[order], taught[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        c, w, n = context[at], word[at], np.add.reduceat(taught, at)
        weight = prior / (count_of(c) + prior)
        unseen = np.log10(weight) + log_base(count_of(w))
        has = np.flatnonzero(n)
        log_prob = np.log10((n[has] + prior * 10.0 ** log_base(count_of(w[has]))) / (count_of(c[has]) + prior))
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie.build(c[has], w[has], log_prob).save(folder)
            found = trie.find(c, w)
            result = quantised(unseen)
            hit = found >= 0
            result[hit] = trie.codes[found[hit]]
            del trie
        out = np.empty(len(order), dtype=np.uint16)
        out[order] = result[np.cumsum(new) - 1]
        parts = np.split(out, np.cumsum(size)[:-1])
        release()
        return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
                         "payload": pa.array([press(codes=p) for p in parts], pa.binary())})

    probabilities = (asked.where("shard is not null").select("block", "shard", "payload").groupBy("shard")
                     .applyInArrow(answer_pairs, "block long, shard long, payload binary"))

    def total(state, answers):
        if not state.num_rows:
            return pa.table({"id": pa.array([], state.schema.field("ids").type.value_type), "train": pa.array([], pa.bool_()),
                             "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
                             "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        s = unpress(state.column("payload")[0].as_py())
        by_shard = sorted(zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()), key=lambda x: x[0])
        log_prob = unquantised(np.concatenate([unpress(p)["codes"] for _, p in by_shard]))
        again = s["again"].astype(np.int64)
        rank = np.where(again > 0, again - 1, np.cumsum(again == 0) - 1)
        sizes = s["sizes"].astype(np.int64)
        sums = np.add.reduceat(log_prob[s["place"][rank]], np.cumsum(sizes) - sizes)
        release()
        return pa.table({"id": state.column("ids")[0].values, "train": pa.array(s["train"].astype(bool)), "n_tokens": pa.array(sizes),
                         "n_known": pa.array(s["known"].astype(np.int64)), "base_score": pa.array(s["base"]), "score": pa.array(sums)})

    states = asked.where("shard is null").select("block", "ids", "payload")
    return (states.groupBy("block").cogroup(probabilities.groupBy("block"))
            .applyInArrow(total, f"id {id_type}, train boolean, n_tokens long, n_known long, base_score double, score double")
            .withColumn("train_tokens", F.lit(n_all).cast("long")))
