"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Encoding splits texts into the matches of the tokenizer's pattern, keeps each
distinct match once, and merges its bytes with Spark higher-order functions: a
fold over the array of byte ids replaces, step by step, the leftmost pair of
lowest rank.  Ranks come from a literal map from pairs of ids to the id of their
concatenation, laid out as a hash table with two slots a pair so that a look-up
reads two numbers at most.  Decoding concatenates the binary pieces of the ids.

Texts are cut into blocks of bounded bytes.  A block sends its distinct matches
once, by match, to the fold, and gets their ids back; its documents travel as
compressed numbers of matches.  The blocks must come out the same when a task is
repeated, so ``docs`` should be read from files (``common.stage`` does that).

The fold copies arrays, so its cost per match is quadratic in the match's bytes;
matches beyond ``FOLD_BYTES`` bytes are merged by the same rule with a heap.

Null and empty texts have no ids (an empty array) and decode to no bytes;
repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ragged, release, slices, text_buffer

FOLD_BYTES = 64
BLOCK_BYTES = 48 << 20
SLICE_BYTES = 2 << 20
ANSWER_ROWS = 1 << 18
NONE = 1 << 40  # the rank of a pair that does not merge
RANK_BITS = 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of every piece of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the concatenation of two pieces, for all pairs that have one."""
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


# ---- the fold ---------------------------------------------------------------

def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_slots(pairs: dict[tuple[int, int], int], size: int) -> list[int]:
    """Hash table of the pairs: each in one of its two slots, as key * 2^RANK_BITS + rank."""
    n = int(2.4 * len(pairs)) | 1
    while True:
        slots: list = [None] * n
        for pair in pairs:
            entry, at = pair, _slots(*pair, size, n)[0]
            for _ in range(500):
                entry, slots[at] = slots[at], entry
                if entry is None:
                    break
                one, two = _slots(*entry, size, n)
                at = two if at == one else one
            if entry is not None:
                break
        else:
            return [-1 if e is None else ((e[0] * size + e[1]) << RANK_BITS) | pairs[e] for e in slots]
        n += 2  # a cycle: other slots


def _slots(a, b, size: int, n: int) -> tuple:
    return (a * size + b) % n, (a * 31337 + b * 7919) % (n - 2)


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array of bigint) of a non-empty binary column, merged by rank."""
    size = max(ranks.values()) + 1
    slots = rank_slots(pair_ranks(ranks), size)
    literal = F.from_json(F.lit("[" + ",".join(map(str, slots)) + "]"), "array<bigint>")
    single = F.from_json(F.lit(str([ranks.get(bytes([b]), -1) for b in range(256)])), "array<bigint>")
    # bound to a variable once, so that the plan holds the literal map once
    return _let(literal, lambda table: _fold(word, table, single, size, len(slots)))


def _fold(word: Column, table: Column, single: Column, size: int, n_slots: int) -> Column:
    none = F.array().cast("array<bigint>")
    n = F.octet_length(word)

    def rank(a: Column, b: Column) -> Column:
        key = a * size + b
        one, two = (F.get(table, slot.cast("int")) for slot in _slots(a, b, size, n_slots))
        mask = (1 << RANK_BITS) - 1
        return (F.when(F.shiftright(one, RANK_BITS) == key, one.bitwiseAND(mask))
                .when(F.shiftright(two, RANK_BITS) == key, two.bitwiseAND(mask)).otherwise(F.lit(NONE)))

    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(
        single, F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int")))

    def ranks_of(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: rank(F.element_at(parts, i), F.element_at(parts, i + 1)))).otherwise(none)

    def merge(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(low: Column, pos: Column) -> Column:
            count = F.size(p)
            left = F.when(pos > 1, F.array(rank(F.element_at(p, pos - 1), low))).otherwise(none)
            right = F.when(pos + 2 <= count, F.array(rank(low, F.element_at(p, pos + 2)))).otherwise(none)
            parts = F.concat(F.slice(p, 1, pos - 1), F.array(low), F.slice(p, pos + 2, count))
            next_ranks = F.concat(F.slice(r, 1, F.greatest(pos - 2, F.lit(0))), left, right, F.slice(r, pos + 2, count))
            return F.struct(parts.alias("p"), next_ranks.alias("r"))

        return _let(F.array_min(r), lambda low: F.when(low.isNull() | (low >= NONE), state).otherwise(
            _let(F.array_position(r, low).cast("int"), lambda pos: at(low, pos))))

    first = _let(start, lambda p: F.struct(p.alias("p"), ranks_of(p).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), n), first, merge, lambda s: s["p"])


# ---- matches longer than the fold takes -------------------------------------

def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word``: always the leftmost pair of lowest rank is merged next."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            rank = ranks.get(word[i:end[end[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
        offer(i)
        offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


# ---- splitting --------------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE = range(4)


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex
    table = np.zeros(0x110000, dtype=np.uint8)
    everything = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(everything)
    point = np.array([ord(c) for c in everything])
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[point[m.start():m.end()]] = value
    return table


def match_starts(raw: np.ndarray, doc_off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pattern's matches start; the matches of a text cover it.

    Works on runs of one character class: a run of letters, numbers or others
    takes a space before it along; a run of white space gives up its last
    character to what follows; an apostrophe of its own takes a contraction's
    letters from the run after it.
    """
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(cp)
    wide = np.flatnonzero(cp >= 0x80)
    more = cp[wide]
    more = 1 + (more >= 0x800).astype(np.int64) + (more >= 0x10000) - ((more >= 0xDC80) & (more <= 0xDCFF)) * 2  # a lone byte is one
    extra = np.concatenate([[0], np.cumsum(more)])

    def byte_at(chars: np.ndarray) -> np.ndarray:
        return chars + extra[np.searchsorted(wide, chars)]

    def char_at(offsets: np.ndarray) -> np.ndarray:
        after = wide + extra[:-1]  # byte offsets of the wide characters
        return offsets - extra[np.searchsorted(after, offsets)]

    doc_at = np.zeros(n + 1, dtype=bool)
    doc_at[char_at(doc_off[:-1])] = True
    doc_at[n] = True
    cls = classes[cp]
    new = doc_at[:n].copy()
    new[1:] |= cls[1:] != cls[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    kind = cls[begin]
    last = doc_at[end]
    start = np.zeros(n, dtype=bool)
    joined = np.zeros(len(begin), dtype=bool)
    words = np.flatnonzero(kind != SPACE)
    at = begin[words]
    joined[words] = ~doc_at[at] & (cp[at - 1] == 0x20)
    start[at - joined[words]] = True
    blank = np.flatnonzero(kind == SPACE)
    b, e = begin[blank], end[blank]
    follows = ~last[blank]
    gives = follows & (cp[e - 1] == 0x20)
    start[b[~gives | (e - b > 1)]] = True
    start[e[follows & ~gives] - 1] = True
    # contractions: s t m d, re ve ll
    quote = np.flatnonzero((kind == OTHER) & (end - begin == 1) & (cp[begin] == 0x27) & ~joined & ~last)
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER]
    at, stop = end[quote], end[quote + 1] if len(quote) else end[:0]
    one = cp[at]
    two = np.where(stop - at > 1, cp[np.minimum(at + 1, n - 1)], 0)
    taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for pair in ("re", "ve", "ll"):
        taken[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    has = taken > 0
    at, stop, taken = at[has], stop[has], taken[has]
    start[at] = False
    start[(at + taken)[stop - at > taken]] = True
    return byte_at(np.flatnonzero(start))


def matches(col: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All matches of a string column as one array of bytes, and each row's offset in it."""
    raw, doc_off = text_buffer(col)
    at = match_starts(raw, doc_off, classes)
    off = np.append(at, len(raw)).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(raw))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off), data]), np.searchsorted(at, doc_off)


# ---- encoding ---------------------------------------------------------------

def _blocks(docs: DataFrame, classes, block_bytes: int, words: bool) -> DataFrame:
    """Rows of all blocks: (block, place, word) of the distinct matches, or
    (block, ids, sizes, places) of some documents each: their ids, their numbers
    of matches, and the compressed places of these."""
    import zstandard

    def run(batches):
        part = TaskContext.get().partitionId() << 24
        held, size, seq = [], 0, 0

        def emit():
            block = part + seq
            every = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
            vocabulary = every.chunk(0).dictionary
            count = np.zeros(len(vocabulary), dtype=np.int64)
            for chunk in every.chunks:
                count += np.bincount(chunk.indices.to_numpy(), minlength=len(vocabulary))
            by_count = np.argsort(-count, kind="stable")  # frequent matches get small places
            if words:
                for at in range(0, len(vocabulary), 100_000):
                    some = by_count[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                         vocabulary.take(pa.array(some)).cast(pa.binary())], names=["block", "place", "word"])
                return
            place = np.empty(len(vocabulary), dtype=np.uint32)
            place[by_count] = np.arange(len(vocabulary), dtype=np.uint32)
            press = zstandard.ZstdCompressor(level=6)
            for k, (_, doc, ids) in enumerate(held):
                codes = place[every.chunk(k).indices.to_numpy()]
                # bytes of equal weight together: the high ones are mostly zero
                packed = press.compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes())
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one(ids), one(pa.array(np.diff(doc).astype(np.int32))), pa.array([packed], pa.binary())],
                    names=["block", "ids", "sizes", "places"])

        for batch in slices(batches, SLICE_BYTES):
            m, doc = matches(batch.column(1), classes.value)
            held.append((m.dictionary_encode(), doc, batch.column(0)))
            size += batch.nbytes
            if size >= block_bytes:
                yield from emit()
                held, size, seq = [], 0, seq + 1
        if held:
            yield from emit()

    id_type = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, "block long, place int, word binary" if words
                           else f"block long, ids array<{id_type}>, sizes array<int>, places binary")


def _packed_answers(words: DataFrame, ranks) -> DataFrame:
    """(block, places, sizes, ids): the ids of many matches of a block in one row;
    matches that the fold left out are merged here."""
    import zstandard

    def run(batches):
        held, rows = [], 0
        press = zstandard.ZstdCompressor(level=3)

        def emit():
            block = np.concatenate([h[0] for h in held])
            place = np.concatenate([h[1] for h in held])
            size = np.concatenate([np.diff(h[2]) for h in held])
            flat = np.concatenate([h[3] for h in held])
            start = np.cumsum(size) - size
            order = np.lexsort((place, block))
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for at in np.split(order, cuts):
                step = np.diff(place[at], prepend=0).astype(np.uint32)
                pack = lambda x, t: press.compress(np.ascontiguousarray(
                    x.astype(t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[at[0]])])] + [pa.array([pack(x, np.uint32)], pa.binary()) for x in (
                        step, size[at], flat[ragged(start[at], size[at])])],
                    names=["block", "places", "sizes", "ids"])

        for batch in batches:
            ids = batch.column(2)
            if ids.null_count:
                ids = pa.array([heap_merges(w, ranks.value) if w is not None else x
                                for x, w in zip(ids.to_pylist(), batch.column(3).to_pylist())], pa.list_(pa.int32()))
            off = ids.offsets.to_numpy()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), off, ids.values.to_numpy()[off[0]:off[-1]]))
            rows += batch.num_rows
            if rows >= ANSWER_ROWS:
                yield from emit()
                held, rows = [], 0
        if rows:
            yield from emit()

    return words.mapInArrow(run, "block long, places binary, sizes binary, ids binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id",
           block_bytes: int = BLOCK_BYTES, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """``(id, ids)`` of every row: the ids (array of int) of its text."""
    import zstandard
    spark = docs.sparkSession
    sc = spark.sparkContext
    classes = sc.broadcast(character_classes())
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[0].dataType.simpleString()
    words = _blocks(docs, classes, block_bytes, True).repartition("word")
    # the fold runs once per distinct match: on the first of its rows
    by_word = Window.partitionBy("word").orderBy("block")
    first = F.row_number().over(by_word) == 1
    merged = fold_merges(F.col("word"), ranks)
    # no Python in between, so that both windows and the fold share one exchange
    words = words.withColumn("_ids", F.when(first & (F.octet_length("word") <= fold_bytes), merged))
    words = words.withColumn("ids", F.first("_ids", ignorenulls=True).over(
        by_word.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("array<int>"))
    words = _packed_answers(words.select("block", "place", "ids", F.when(F.col("ids").isNull(), F.col("word")).alias("word")),
                            sc.broadcast(ranks))
    coded = _blocks(docs, classes, block_bytes, False)

    def assemble(documents: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()

        def unpacked(packed) -> np.ndarray:
            return np.ascontiguousarray(np.frombuffer(unpack.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()

        rows = answers.to_pylist()
        place = np.concatenate([np.cumsum(unpacked(r["places"]).astype(np.int64)) for r in rows] or [np.zeros(0, np.int64)])
        found = np.concatenate([unpacked(r["sizes"]).astype(np.int64) for r in rows] or [np.zeros(0, np.int64)])
        flat = np.concatenate([unpacked(r["ids"]) for r in rows] or [np.zeros(0, np.uint32)]).astype(np.int32)
        start, size = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
        start[place], size[place] = np.cumsum(found) - found, found
        chunks = []
        for k in range(documents.num_rows):
            codes = unpacked(documents.column("places")[k].as_py())
            n_matches = documents.column("sizes")[k].values.to_numpy()
            until = np.concatenate([[0], np.cumsum(size[codes])])[np.concatenate([[0], np.cumsum(n_matches)])]
            chunks.append(pa.RecordBatch.from_arrays(
                [documents.column("ids")[k].values,
                 pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(flat[ragged(start[codes], size[codes])]))],
                names=["id", "ids"]))
        del start, size, flat, place, found
        release()
        schema = pa.schema([("id", documents.schema.field("ids").type.value_type), ("ids", pa.list_(pa.int32()))])
        return pa.Table.from_batches(chunks, schema)

    return (coded.groupBy("block").cogroup(words.groupBy("block"))
            .applyInArrow(assemble, f"id {id_type}, ids array<int>")
            .withColumnRenamed("id", id_col))


# ---- decoding ---------------------------------------------------------------

def piece_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces by id, concatenated, and each id's offset."""
    by_id = {i: p for p, i in ranks.items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), off


def decoded(ids: pa.Array, table) -> list[bytes]:
    """Concatenated pieces of each row of an array-of-int column (null: none)."""
    data, off = table
    out = []
    lists, starts = ids.values.to_numpy(), ids.offsets.to_numpy()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        x = lists[a:b]
        out.append(data[ragged(off[x], off[x + 1] - off[x])].tobytes())
    return out


def decode(coded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` plus the decoded bytes of ``ids_col``."""
    from pyspark.sql import types as T
    pieces = coded.sparkSession.sparkContext.broadcast(piece_table(ranks))

    def run(batch):
        return {out_col: decoded(batch.column(batch.schema.get_field_index(ids_col)), pieces.value)}

    return map_batches(coded, run, T.StructType([T.StructField(out_col, T.BinaryType())]))
