"""Keyed tables and the streaming ingest: late rows, replays, stopped batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from encyclo.operators.pages import build_tables
from encyclo.sources import sinks as S
from encyclo.sources.dump import read_dump
from encyclo.sources.keyed import KeyedTable
from encyclo.streaming.ingest import PAGE_COLUMNS, IngestState, stream_ingest

COLS = ["id", "title", "categories", "cited_domains", "cited_authors", "quality", "importance", "slug"]


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and f.endswith(".parquet"))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ---- keyed tables ---------------------------------------------------------------------

def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", "k long, v string, at long", buckets=8)
    frame = lambda rs: spark.createDataFrame(rs, "k long, v string, at long")
    t.merge(frame([(i, f"v{i}", 0) for i in range(100)]), ("s", 0))
    before = files(tmp_path)
    assert len(before) == 8 and t.read().count() == 100
    t.merge(frame([(5, "new", 1), (1000, "more", 1)]), ("s", 1))
    assert 1 <= len(set(files(tmp_path)) - set(before)) <= 2
    assert rows(t.read().where("k in (5, 6, 1000)"), "k", "v") == [(1000, "more"), (5, "new"), (6, "v6")]
    assert t.read().count() == 101 and t.lookup(frame([(5, "", 0)]).select("k")).count() == 1
    now = files(tmp_path)
    t.merge(frame([(5, "other", 2)]), ("s", 1))               # a replayed batch
    t.merge(frame([(5, "new", 9), (6, "v6", 9)]), ("s", 2), ignore=("at",))  # no change
    assert files(tmp_path) == now and rows(t.read().where("k = 5"), "v", "at") == [("new", 1)]
    t.merge(frame([(5, "kept", 3)]), ("other", 0), keep=lambda old, new, c: (old if c == "at" else new)[c])
    assert rows(t.read().where("k = 5"), "v", "at") == [("kept", 1)]
    assert t.vacuum(1) > 0 and t.read().count() == 101
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), "k", "k long, v string, at long", buckets=9).read()


def test_append_is_a_set_and_spreads_a_hot_key(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", "k string, v long", buckets=16, spread=8)
    hot = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    t.append(hot.union(hot).union(spark.createDataFrame([(None, 1), ("x", None)], "k string, v long")), ("s", 0))
    assert t.read().count() == 502 and t.lookup(hot.select("k")).count() == 500
    assert sum("bucket=" in f for f in files(tmp_path)) >= 8
    n = len(files(tmp_path))
    t.append(hot, ("another", 0))
    assert len(files(tmp_path)) == n and t.read().count() == 502


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", "k long, v long", buckets=4)
    one = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")
    t.merge(one, ("s", 0))
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.merge(one.withColumn("v", F.col("v") + 10), ("s", 1))
    assert rows(t.read(), "k", "v") == [(1, 1), (2, 2)]
    monkeypatch.undo()
    t.merge(one.withColumn("v", F.col("v") + 20), ("s", 1))
    assert rows(t.read(), "k", "v") == [(1, 21), (2, 22)]


# ---- ingest ---------------------------------------------------------------------------

def expected(pages, cutoff):
    t = build_tables(pages, cutoff=cutoff)
    parts = {k: t[k] for k in ("categories", "domains", "authors", "quality", "importance")}
    return rows(S.articles_projection(t["titles"], pages, **parts), *COLS), rows(t["links"], "id", "pos", "link_id")


@pytest.mark.parametrize("seed", [0, 1])
def test_batches_in_any_order_equal_one_batch(spark, tmp_path, seed):
    pages = read_dump(spark, os.path.join(FIXTURES, "mini_dump.xml")).collect()
    later = [p for p in pages if p.title.startswith(("Talk:", "Category:")) or p.redirect]
    first = [p for p in pages if p not in later]
    if seed:  # talk pages, categories and redirects before and after their articles
        random.Random(seed).shuffle(pages)
        parts = [pages[k::4] for k in range(4)]
    else:     # all of them late
        parts = [first, later[::2], later[1::2]]
    twin = pages[0].asDict() | {"id": 5000, "title": "Alpha", "ns": 0, "redirect": None, "raw_text": "again [[Category:Symbols]]"}
    schema = "id bigint, ns int, title string, redirect string, ts timestamp, raw_text string"
    assert schema == PAGE_COLUMNS
    parts = [spark.createDataFrame([tuple(p) for p in part], schema) for part in parts]
    parts.append(spark.createDataFrame([tuple(twin[c] for c in ("id", "ns", "title", "redirect", "ts", "raw_text"))], schema))
    whole = parts[0]
    state = IngestState(spark, str(tmp_path / "state"), buckets=4)
    for k, part in enumerate(parts):
        whole = part if k == 0 else whole.unionByName(part)
        state.add(part, ("test", k), cutoff="20010115")
        if k >= len(parts) - 1 - seed:  # equal after all pages, and after a page of a known title
            arts, links = expected(whole, "20010115")
            assert rows(state.articles(), *COLS) == arts
            assert rows(state.links(), "id", "pos", "link_id") == links
    before = files(tmp_path / "state")
    state.add(parts[1], ("test", 1), cutoff="20010115")                   # a replay
    state.add(whole, ("another stream", 0), cutoff="20010115")            # all of it once more
    assert files(tmp_path / "state") == before


def test_stream_of_files(spark, tmp_path):
    pages = read_dump(spark, os.path.join(FIXTURES, "mini_dump.xml"))
    src = tmp_path / "incoming"
    for k in range(3):
        pages.where(F.col("id") % 3 == k).coalesce(1).write.parquet(str(src / f"part{k}"))
    state = IngestState(spark, str(tmp_path / "state"), buckets=2)
    q = stream_ingest(spark, f"{src}/*", state, str(tmp_path / "ck"), files_per_batch=1)
    q.awaitTermination()
    assert q.exception() is None and state.articles_table.last()["sources"] == {str(tmp_path / "ck"): 2}
    assert rows(state.articles(), *COLS) == expected(pages, None)[0]
    times = dict(rows(state.articles(), "id", "created_at"))
    again = stream_ingest(spark, f"{src}/*", state, str(tmp_path / "ck2"), files_per_batch=2)
    again.awaitTermination()
    assert again.exception() is None and dict(rows(state.articles(), "id", "created_at")) == times
