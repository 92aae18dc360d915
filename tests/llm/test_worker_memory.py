"""What a Python worker holds of the pipeline's texts, pairs and groups."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from encyclo.llm import langid, passages, simhash

MB = 1 << 20


class Tasks:
    """Stands for a table: keeps the function that its tasks would run."""

    columns = ["doc_id", "text"]
    schema: dict = {}

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, fn, _):
        self.fn = fn
        return self


def peak(batches) -> float:
    tracemalloc.start()
    for _ in batches:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / MB


@pytest.fixture(scope="module")
def texts():
    """8 MB of texts of 3 KB as one batch, as Arrow hands it over."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{k:x}" for k in range(20_000)])
    rows = [" ".join(words[rng.integers(0, len(words), 400)]) for _ in range(8 * MB // 3200)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["id", "text"])


def test_windows_of_a_large_batch(texts):
    """op8_passages, pipeline: the hashes of all words of a batch took 800 MB at once."""
    assert peak(passages.windows(Tasks(), hashes=2).fn(iter([texts]))) < 150


def test_fingerprints_of_a_large_batch(texts, monkeypatch):
    """pipeline: the shingles of all texts of a batch were made at once."""
    made = []
    monkeypatch.setattr(simhash, "map_batches", lambda df, fn, schema, keep, size=8 * MB: made.append((fn, size)))
    simhash.fingerprints(Tasks(), keep=["id"])
    (fn, size), = made
    step = len(texts) * size // texts.nbytes
    assert peak(fn(texts.slice(at, step)) for at in range(0, len(texts), step)) < 150


def pair_rows(n: int, size: int = 400):
    """Batches of one document's pairs, each of it and an original that shares nothing."""
    rng = np.random.default_rng(5)
    for k in range(n):
        sides = [rng.integers(0, 1 << 62, size, dtype=np.uint64) for _ in range(2)]
        yield batch_of([(7, 70, k, k, 0, 9, k, side, 0, size - 1, part.tobytes()) for side, part in enumerate(sides)])


def batch_of(rows):
    names = ["x", "xh", "a", "ah", "c", "e", "pair", "side", "lo", "hi", "part"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def accepted(batches):
    out = passages.accepted_passages(iter(batches), 46, 0.8, 5)
    return sorted(tuple(r.values()) for b in out for r in b.to_pylist())


def test_pairs_are_not_held():
    """op8_passages, pipeline: all pairs of a document, 262,144 rows at least, were held at once."""
    assert peak(passages.accepted_passages(pair_rows(2000), 46, 0.8, 5)) < 2


@pytest.mark.parametrize("rows_at_once", [1, 2, 3, 100])
def test_pairs_cut_anywhere(rows_at_once):
    """A pair's sides, their repeats and a document's pairs may come in any batches."""
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    shared = some(60)
    own, other = np.concatenate([some(10), shared, some(10)]), np.concatenate([shared, some(30)])
    rows = []
    for pair, (x, a, c, mate) in enumerate([(1, 0, 12, other), (1, 0, 75, some(90)), (2, 0, 12, other), (2, 1, 20, other), (3, 0, 5, some(90))]):
        rows += [(x, x, a, a, c, c + 3, pair, 0, 100, 180, own.tobytes())] * 2  # of equal id and text
        rows.append((x, x, a, a, c, c + 3, pair, 1, 40, 130, mate.tobytes()))
    rows.append((3, 3, 9, 9, 5, 8, 9, 0, 100, 180, own.tobytes()))  # the other side is missing
    cut = [batch_of(rows[at:at + rows_at_once]) for at in range(0, len(rows), rows_at_once)]
    expected = [(1, 1, 110, 174, 0), (2, 2, 110, 174, 0), (2, 2, 110, 174, 1)]
    assert accepted(cut) == expected == accepted([batch_of(rows)])
    # a region whose windows lie in what was accepted before needs no other original
    inside = [r[:4] + (112, 115) + r[6:] for r in rows]
    assert accepted([batch_of(inside)]) == expected[:2]


@pytest.mark.parametrize("rows_at_once", [1, 4, 50])
def test_groups_larger_than_the_buffer(spark, monkeypatch, rows_at_once):
    """op8_passages: a group is never split, however small the buffer."""
    seen = []

    class Frame(Tasks):
        columns = ["k", "v"]

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

    def note(cols, first):
        seen.extend((int(cols["k"][s]), cols["v"][s:e].tolist()) for s, e in itertools.pairwise([*first, len(cols["k"])]))
        return iter(())

    monkeypatch.setattr(passages, "BUFFER_ROWS", 8)
    k = np.repeat([1, 2, 3, 4], [3, 40, 1, 6])
    batch = pa.RecordBatch.from_arrays([pa.array(k), pa.array(range(50))], names=["k", "v"])
    list(passages.grouped(Frame(), ["k"], ["v"], note, "").fn(batch.slice(at, rows_at_once) for at in range(0, 50, rows_at_once)))
    assert seen == [(g, np.flatnonzero(k == g).tolist()) for g in (1, 2, 3, 4)]


def test_language_id_hands_each_text_over_once(spark, monkeypatch):
    """pipeline: the text went to the tasks twice, in the row and beside it."""
    import corpus_pipeline
    handed, predict = [], langid.predict
    monkeypatch.setattr(langid, "predict", lambda docs, *a, **kw: handed.append(docs) or predict(docs, *a, **kw))
    schema = "doc_id long, text string, lang string, score double, lang_pred string, _text string"
    rows = [(1, "der hund und die katze", "de", 0.5, "x", "y"), (2, "the dog and the cat", "en", None, None, None),
            (3, "the cat and the dog", None, 1.0, "z", ""), (4, "12 34", "en", 2.0, "", None), (5, None, "de", 3.0, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.language_id(spark, docs, "")
    # names that clash with the new columns stay
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[1], (3, rows[2][1], "en", 1.0, "z", "")]
    text, = [c for c in handed[0].columns if c.lstrip("_") == "1"]
    assert [t for _, t in handed[0].dtypes].count("string") == 4 and not any("struct" in t for _, t in handed[0].dtypes) and text
