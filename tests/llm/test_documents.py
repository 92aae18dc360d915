"""Operators on documents against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from encyclo.llm import bpe, decontaminate, langid, ngram, passages, repeats, simhash
from encyclo.llm.components import components, merge_labels
from encyclo.llm.queries import tokenizer_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_text = text(70), text(3000)
    near = text(200).split()
    changed = [w if k % 67 else "other" for k, w in enumerate(near)]
    texts = [None, "", "  \n", "!!! 123", "One", text(3), text(40), text(40) + "\tÉté \x00 naïve", passage, text(30) + " " + passage + " " + text(20),
             text(25) + "\n" + passage.upper(), " ".join(near), " ".join(changed), long_text, long_text, "x" * 3000, "ab " * 900, text(500), text(500)]
    out = [(k, t, ["en", "fr", None][k % 3], "s", len(t or ""), 1.0, "x") for k, t in enumerate(texts)]
    return out + [(None, text(60), "en", "s", 1, 1.0, "x"), out[13], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_components(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    chain = [(1000 + k, 1001 + k) for k in range(40)]
    pairs = [(int(x), int(y)) for x, y in zip(a, b)] + chain + [(5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    labels = merge_labels(np.arange(1100), *(np.array(c) for c in zip(*pairs[:-1])))
    touched = {x for p in pairs[:-1] if p[0] != p[1] for x in p}
    assert got == {x: int(labels[x]) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination ----------------------------------------------------------

def brute_decontaminate(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut(text)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows[tuple(w[k:k + m])].add(item)
    out = []
    for r in rows:
        w, hit, found = cut(r[1]), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k:k + m])]
        out.append((r[0], len(w), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontaminate(spark, docs, rows, block):
    words = rows[17][1].split()
    items = [(1, " ".join(words[100:140])), (2, " ".join(words[110:130])), (3, "ONE"), (4, None), (5, " ; "), (None, rows[6][1]),
             (10, rows[8][1].upper()), (10, "2 naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.verdict(decontaminate.mark(docs, bench, block_windows=block))
    assert {"source", "score"} <= set(got.columns)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()], key=str) == brute_decontaminate(rows, items)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[4] for x in brute_decontaminate(rows, items))


def test_decontaminate_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.verdict(decontaminate.mark(docs, none)).collect()} == {0}
    assert decontaminate.mark(empty, none).count() == 0


# ---- language identification --------------------------------------------------

def test_langid(spark, docs, empty):
    rng = random.Random(3)
    made = {"aa": "abcde", "bb": "vwxyz", "cc": "абвгд"}
    word = lambda l: "".join(rng.choice(made[l]) for _ in range(5))
    train = [(" ".join(word(l) for _ in range(40)), l) for l in made for _ in range(20)] + [(None, "aa"), ("abc", None), ("", "bb")]
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    mixed = " ".join([word("aa") for _ in range(30)] + [word("bb") for _ in range(10)] + [word("cc") for _ in range(5)])
    frame = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, "1 2 ²", "x"), (4, word("cc"), "x")], "id long, text string, spans string")
    got = {r.id: r for r in langid.predict(frame, model).collect()}
    assert (got[1].lang_pred, round(got[1].score, 3)) == ("aa", round(30 / 45, 3))
    assert [tuple(s) for s in got[1].spans] == [(0, 30, "aa"), (30, 40, "bb"), (40, 45, "cc")]
    assert [(got[k].lang_pred, got[k].score) for k in (2, 3)] == [("und", 0.0)] * 2
    assert (got[4].lang_pred, got[4].score) == ("cc", 1.0)
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_langid_held_out(spark):
    from encyclo.llm.queries import op4_langid
    sf = "/root/testdata/sf0.01"
    got = op4_langid(spark, sf).join(spark.read.parquet(sf + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null").toPandas()
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_viterbi_is_best_path():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(6, 3)).astype(np.float32)
    codes, off = rng.integers(0, 6, 11), np.array([0, 4, 4, 11])
    got = langid.viterbi(scores, codes, off, 0.7)
    import itertools
    for a, b in zip(off[:-1], off[1:]):
        value = lambda p: sum(scores[codes[a + k], x] for k, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
        if b > a:
            assert math.isclose(value(got[a:b]), max(value(p) for p in itertools.product(range(3), repeat=b - a)), rel_tol=1e-5)


# ---- SimHash --------------------------------------------------------------------

def brute_fingerprint(text, size=4):
    w = split_words(text)
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, rows, empty):
    prints = [brute_fingerprint(r[1]) for r in rows]
    labels = np.arange(len(rows))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if bin(a ^ b).count("1") <= 4:
                labels = merge_labels(labels, np.array([i]), np.array([j]))
    low = {k: min((rows[i][0] for i in range(len(rows)) if labels[i] == k and rows[i][0] is not None), default=None) for k in set(labels.tolist())}
    want = sorted([(r[0], p, low[int(k)]) for r, p, k in zip(rows, prints, labels)], key=str)
    got = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()], key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(low) and {r.doc_id for r in kept.collect()} == set(low.values())
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("bits,group", [(16, 8192), (16, 8), (8, 8192)])
def test_simhash_links(spark, bits, group):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30).tolist() + [0]
    near = []
    for x in base:
        for _ in range(8):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            near.append(x)
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in base + near})
    v = np.array(fps).view(np.uint64)
    labels = np.arange(len(v))
    for i in range(len(v)):
        j = np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 4)
        labels = merge_labels(labels, np.full(len(j), i), j)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), group_rows=group, bits=bits)
    got = {r.node: r.component for r in components(found).collect()}
    assert {x: got.get(x, x) for x in fps} == {x: fps[k] for x, k in zip(fps, labels.tolist())}


def test_anchors_cover():
    rng = np.random.default_rng(5)
    for bits in (8, 16):
        table = simhash.nearest_table(bits, 2)
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, 4, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        (rx, ax), (ry, ay) = simhash.anchors_of(x, table, bits, 2), simhash.anchors_of(y, table, bits, 2)
        assert all(set(ax[rx == k]) & set(ay[ry == k]) for k in range(len(x)))


# ---- passages ---------------------------------------------------------------------

def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        v, length = rng.integers(0, 12, n).astype(np.uint64), int(rng.integers(1, 8))
        off = np.array([0, *np.sort(rng.integers(0, n + 1, 2)), n])
        got = {(i, j): c for l, c, r in zip(*(x.tolist() for x in passages.compact_windows(v, off, length)))
               for i in range(l, c + 1) for j in range(c, r + 1) if j - i + 1 >= length}
        want = {(i, j): i + int(v[i:j + 1].argmin()) for a, b in zip(off[:-1], off[1:]) for i in range(a, b) for j in range(i + length - 1, b)}
        assert got == want


def test_paired_windows():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(0, 40))
        one, two = (rng.integers(0, 30, n).astype(np.uint64) for _ in range(2))
        length = int(rng.integers(1, 20))
        off = np.array([0, *np.sort(rng.integers(0, n + 1, 2)), n])
        reach = [{c: (l, r) for l, c, r in zip(*(x.tolist() for x in passages.compact_windows(v, off, length)))} for v in (one, two)]
        centres = {(i + int(one[i:i + length].argmin()), i + int(two[i:i + length].argmin()))
                   for a, b in zip(off[:-1], off[1:]) for i in range(a, b - length + 1)}
        got = list(zip(*(x.tolist() for x in passages.paired_windows(one, two, off, length))))
        assert len(got) == len(centres) and {x[1:3] for x in got} == centres
        for l, c, d, r in got:
            (p, q), (u, v) = reach[0][c], reach[1][d]
            assert (l, r) == (min(p, u), max(q, v))


def test_passages_recall(spark):
    """Exact and near copies (one or two words of 50 to 60 changed, similarity 0.8 or more, the first
    and the last five words kept: a passage begins and ends with a shared shingle) between other words, against the planted places; documents that share only a line of 12 words have none."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghinorst") for _ in range(8))
    some = lambda n: [word() for _ in range(n)]
    line, rows, planted = some(12), [], {}
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    while len(planted) < 200:
        passage = some(rng.randrange(50, 61))
        copy = list(passage)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(5, len(copy) - 5)] = word()
        a, b = sets(passage), sets(copy)
        if len(a & b) < 0.8 * len(a | b):
            continue
        k, before = 2 * len(planted), rng.randrange(40)
        rows += [(k, " ".join(some(rng.randrange(40)) + passage + some(20))), (k + 1, " ".join(some(before) + copy + some(30)))]
        planted[k + 1] = (before, before + len(copy), copy == passage)
    rows += [(1000 + k, " ".join(some(60) + line + some(60))) for k in range(150)]
    got = {r.id: r for r in passages.spans_by_document(passages.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert set(got) <= set(planted) and all(got[k].originals == [k - 1] for k in got)
    inside = lambda k, a, b: sum(max(0, min(b, y) - max(a, x)) for x, y in zip(got[k].spans[::2], got[k].spans[1::2])) if k in got else 0
    assert all(inside(k, a, b) == b - a for k, (a, b, same) in planted.items() if same)
    near = [inside(k, a, b) >= 0.9 * (b - a) - 5 for k, (a, b, same) in planted.items() if not same]
    assert len(near) > 40 and sum(near) >= 0.95 * len(near)


def test_passages_of_one_short_text(spark):
    for n in (0, 4, 14, 49):
        docs = spark.createDataFrame([(1, " ".join(str(k) for k in range(n)))], "doc_id long, text string")
        assert passages.duplicate_spans(docs).count() == 0


@pytest.mark.parametrize("hot", [passages.HOT_IN_SAMPLE, 2])
def test_passages(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_IN_SAMPLE", hot)
    spans = {(r.id, r.h): r for r in passages.spans_by_document(passages.duplicate_spans(docs)).collect()}
    of = lambda k: spans.get((rows[k][0], zlib.crc32((rows[k][1] or "").encode())))
    # the passage stays in document 8 and goes in 9 and 10
    assert of(8) is None
    for k, before in ((9, 30), (10, 25)):
        a, b = of(k).spans
        assert abs(a - before) <= 5 and abs(b - before - 70) <= 5 and 8 in of(k).originals
    # near copy with changed words (similarity above 0.8), whole copy, and nothing else
    assert sum(of(12).spans[1::2]) - sum(of(12).spans[::2]) >= 190 and of(11) is None
    assert of(14).spans == [0, 3000] and of(13) is None
    assert {k[0] for k in spans} == {9, 10, 12, 14}
    cut = passages.remove_duplicates(docs)
    texts = collections.defaultdict(list)
    for r in cut.collect():
        texts[r.doc_id].append(r.text)
    assert cut.columns == docs.columns and 14 not in texts and len(texts[13]) == 2
    assert texts[8] == [rows[8][1]] and texts[0] == [None] and texts[None] == [rows[19][1]] and len(texts[9][0].split()) <= 55
    assert passages.remove_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [passages.HOT_IN_SAMPLE, 2])
def test_passages_of_a_family_whose_first_member_is_far(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_IN_SAMPLE", hot)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghinorst") for _ in range(8))
    texts = []
    for family in range(12):
        b = [word() for _ in range(70)]
        far = lambda: b[:32] + [word() for _ in range(6)] + b[38:]  # noqa: E731  shares 56 of 66 shingles
        c = b[:-2] + [word(), word()]
        texts += [far(), far(), b, c]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in passages.spans_by_document(passages.duplicate_spans(docs)).collect()}
    assert set(got) == {4 * k + 3 for k in range(12)}
    assert all(got[k].originals == [k - 1] and got[k].spans[1] - got[k].spans[0] >= 66 for k in got)


def test_passages_of_a_later_place(spark):
    # the first document holds the beginning of the passage several times, the whole only at the last place
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghinorst") for _ in range(8))
    rows, n = [], 12
    for k in range(n):
        passage = [word() for _ in range(60)]
        early = [w for _ in range(2) for w in passage[:30] + [word() for _ in range(40)]]
        rows += [(2 * k, " ".join(early + passage)), (2 * k + 1, " ".join([word() for _ in range(60)] + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.spans for r in passages.spans_by_document(passages.duplicate_spans(docs)).collect()}
    assert got == {2 * k + 1: [60, 120] for k in range(n)}


def test_similarity_threshold():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    other = a.copy()
    other[::3] = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    assert passages.matching_spans(other, a, 46, 0.8) == []
    assert passages.matching_spans(a[20:120], a, 46, 0.8) == [(0, 100)]


def test_similarity_of_repeated_lines():
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 1 << 60, n, dtype=np.uint64)
    line, passage = some(8), some(56)
    passage[24:32] = line
    inside = lambda spans: {k for s, e in spans for k in range(s, e)}
    x = np.concatenate([some(20), passage, some(20)])
    for a in (np.concatenate([line, some(30), passage]), np.concatenate([some(9), passage, some(12), line]),
              np.concatenate([passage[:40], some(30), line, some(5), passage, some(7), line, passage[30:]])):
        assert inside(passages.matching_spans(x, a, 46, 0.8)) == set(range(20, 76))
    # a near copy, and one with words put in
    near, longer = passage.copy(), np.concatenate([passage[:40], some(4), passage[40:]])
    near[45:48] = some(3)
    for x in (near, longer):
        assert inside(passages.matching_spans(x, np.concatenate([line, some(30), line, some(3), passage]), 46, 0.8)) == set(range(len(x)))
    # different lines around a common one are no passage
    assert passages.matching_spans(np.concatenate([some(30), line, some(30)] * 2), np.concatenate([some(30), line] * 9), 46, 0.8) == []


# ---- repeated strings -------------------------------------------------------------

def brute_repeats(texts, length):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()),
                    hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_difference_cover():
    for v in (8, 16, 32, 64):
        cover = repeats.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and (repeats.distances(v, cover) >= 0).all()


def test_string_classes():
    rng = random.Random(3)
    for _ in range(15):
        blocks = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(300, 900))) for _ in range(3)] + [b"x" * 700]
        text = np.frombuffer(b"".join(rng.choice(blocks)[rng.randrange(60):] for _ in range(6)), np.uint8)
        suffix = np.arange(len(text) - 399)
        label = repeats.string_classes(text, suffix)
        data = text.tobytes()
        pairs = collections.defaultdict(set)
        for p, k in zip(suffix.tolist(), label.tolist()):
            pairs[k].add(data[p:p + 400])
        assert all(len(s) == 1 for s in pairs.values()) and len(pairs) == len({data[p:p + 400] for p in suffix.tolist()})


@pytest.mark.parametrize("hot", [repeats.HOT_MEMBERS, 1])
def test_repeats(spark, docs, rows, empty, hot):
    got = sorted([tuple(r) for r in repeats.removed(docs, hot_members=hot).collect()], key=str)
    want = sorted([(r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 400))], key=str)
    assert got == want
    assert repeats.removed(empty).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT_MEMBERS, 1])
def test_repeats_of_a_repeated_row(spark, hot):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(450)
    rows = [(1, text(100) + shared + text(60))] * 3 + [(2, text(80) + shared), (3, text(300)), (3, "x" + shared), (None, text(30) + shared)] + [(None, text(200))] * 2
    got = sorted([tuple(r) for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"), hot_members=hot).collect()], key=str)
    assert got == sorted([(r[0], *x) for r, x in zip(rows, brute_repeats([r[1].encode() for r in rows], 400))], key=str)


# ---- byte-level BPE ---------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return tokenizer_ranks()


@pytest.fixture(scope="module")
def reference_encoding(ranks):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_matches():
    import public_tokenizers
    import regex
    rng = random.Random(1)
    alphabet = ["a", "b", "'", "s", "t", "re", "ll", "ve", "d", " ", "  ", "\n", "\t", "1", "é", "ß", "!", "…", " ", "　", "中", "😀", "'s", "x'", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", None]
    found, off = bpe.matches(pa.array(texts), bpe.character_classes())
    found = found.to_pylist()
    for k, t in enumerate(texts):
        assert found[off[k]:off[k + 1]] == [m.encode() for m in regex.findall(public_tokenizers.PATTERN, t or "")]


def test_heap_merges(ranks, reference_encoding):
    rng = random.Random(2)
    for _ in range(100):
        w = "".join(rng.choice("abcdefghéthein") for _ in range(rng.randrange(1, 300)))
        assert bpe.heap_merges(w.encode(), ranks) == reference_encoding.encode_ordinary(w)


@pytest.mark.parametrize("fold_bytes,block", [(64, 48 << 20), (5, 2000)])
def test_bpe(spark, docs, rows, empty, ranks, reference_encoding, fold_bytes, block):
    coded = bpe.encode(docs, ranks, fold_bytes=fold_bytes, block_bytes=block)
    got = sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(coded, ranks).collect()], key=str)
    want = sorted([(r[0], reference_encoding.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows], key=str)
    assert got == want
    assert bpe.encode(empty, ranks).count() == 0


# ---- language model -----------------------------------------------------------------

def test_elias_fano():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, top = int(rng.integers(0, 60)), int(2 ** rng.integers(1, 62))
        v = np.sort(rng.integers(0, top, n))
        e = ngram.EliasFano.of(v)
        q = np.concatenate([rng.integers(0, top + 5, 50), v, v + 1])
        assert (e.get(np.arange(n)) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


def test_ngram(spark, docs, rows, empty):
    taught = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 0
    frame = docs.select(F.col("doc_id").alias("id"), "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0).alias("train"))
    got = sorted([(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in ngram.score(frame, block_bytes=4000, shard_tokens=500).collect()], key=lambda r: (str(r[0]), r[1:3]))
    ones, pairs, n_docs = collections.Counter(), collections.Counter(), 0
    for r in rows:
        if taught(r):
            w = split_words(r[1])
            ones.update(w + [""])
            pairs.update(zip(["<s>"] + w, w + [""]))
            n_docs += 1
    n, v = sum(ones.values()), len(ones)
    p1 = lambda w: (ones[w] + 0.1) / (n + 0.1 * (v + 1))
    want = []
    for r in rows:
        w = split_words(r[1])
        base = sum(math.log10(p1(x)) for x in w + [""])
        model = sum(math.log10((pairs[h, x] + ngram.PRIOR * p1(x)) / ((n_docs if h == "<s>" else ones[h]) + ngram.PRIOR))
                    for h, x in zip(["<s>"] + w, w + [""]))
        want.append((r[0], len(w) + 1, sum(ones[x] > 0 for x in w + [""]), n, base, model))
    for a, b in zip(got, sorted(want, key=lambda r: (str(r[0]), r[1:3]))):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * b[1] and abs(a[5] - b[5]) < 2e-4 * b[1]
    assert ngram.score(empty.select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("train"))).count() == 0
    unknown = ngram.score(frame.withColumn("train", F.lit(None).cast("boolean"))).collect()
    assert {r.n_known for r in unknown} == {0} and {r.base_score for r in unknown} == {0.0}


def test_ngram_sums_to_one():
    """A context's probabilities over all words and the unknown one."""
    n, v, prior, c = 50, 7, 3.0, [10, 3, 1]
    ones = [20, 10, 8, 6, 3, 2, 1]
    p1 = [(x + 0.1) / (n + 0.1 * (v + 1)) for x in ones + [0]]
    assert math.isclose(sum(p1), 1.0)
    assert math.isclose(sum((x + prior * p) / (sum(c) + prior) for x, p in zip(c + [0] * 5, p1)), 1.0)
