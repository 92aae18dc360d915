"""Texts dealt out over the cluster before they are split, with the results of one task (findings of round 3)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encyclo.llm import langid
from encyclo.llm.common import map_batches
from encyclo.operators import corpus as K
from encyclo.operators import embeddings as E
from encyclo.operators import textpipe as TP
from encyclo.operators import topics as TM
from encyclo.sources.keyed import KeyedTable

TEXTS = [None if i % 41 == 0 else " ".join(f"w{(i * 7 + j * j) % 60}" for j in range(i % 50)) for i in range(600)]


def one_file(spark, path):
    """Texts in one row group, with a repeated and a null id."""
    rows = [(None if i == 5 else 7 if i == 9 else i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def small_parts(spark, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    old = spark.conf.get(key)
    spark.conf.set(key, "1b")
    return lambda: spark.conf.set(key, old)


def test_tokens_of_one_row_group_are_split_in_many_tasks(spark, tmp_path, monkeypatch):
    """a row group is one task's; splitting and counting must not be."""
    docs = one_file(spark, tmp_path / "d")
    back = small_parts(spark, monkeypatch)
    try:
        tok = K.stored_tokens(docs, row_col="row")
    finally:
        back()
    assert len(tok.inputFiles()) > 1
    key = lambda r: (str(r.id), str(r.tokens))
    assert sorted(map(key, tok.collect())) == sorted(map(key, K.tokens(docs).collect()))
    assert sorted(r.row for r in tok.select("row").collect()) == list(range(len(TEXTS)))


def test_topics_of_dealt_texts_are_those_of_the_scan(spark, tmp_path, monkeypatch):
    """blocks made all over the cluster hold the texts that the scan's task would put there."""
    docs = one_file(spark, tmp_path / "d")
    back = small_parts(spark, monkeypatch)
    try:
        tok = K.stored_tokens(docs, row_col="row")
    finally:
        back()
    key = lambda r: (r.block, r.ids, r.lens, r.words, bytes(r.places))
    want = sorted(map(key, TM.pack(K.tokens(docs), block_tokens=1500).collect()))
    assert len(want) > 5 and sorted(map(key, TM.pack(tok, block_tokens=1500, row_col="row").collect())) == want
    got, old = (m.words.orderBy("word").collect() for m in (
        TM.fit(tok, k=3, rounds=2, block_tokens=1500, row_col="row"), TM.fit(K.tokens(docs), k=3, rounds=2, block_tokens=1500)))
    assert got == old


def test_samples_follow_the_formula():
    """the sampler without per-row numpy additions draws what the formula draws."""
    rng, k, n = np.random.default_rng(3), 4, 6000
    places, lens = rng.integers(0, 50, n), [n // 6] * 6
    row = {"block": pa.array([3]), "words": pa.array([[f"w{i}" for i in range(50)]]), "places": pa.array([TM.small(places, 50)], pa.binary()),
           "lens": pa.array([lens], pa.list_(pa.int32()))}
    block, counts, z = TM.Block(row, k), rng.integers(0, 90, (49, k)).astype(float), rng.integers(0, k, n)
    block.take(np.arange(49), counts)  # the last word is not known
    totals, alpha, beta, draw = np.full(k, 2e3), 0.2, 0.01, np.random.default_rng(5)
    got = block.sample(z, totals, alpha, beta, 49, np.random.default_rng(5))
    use, doc, word, want, total = np.flatnonzero(places < 49), np.repeat(np.arange(6), n // 6), np.zeros((50, k)), z.copy(), totals
    word[:49], of_doc = counts, np.zeros((6, k))
    np.add.at(of_doc, (doc[use], z[use]), 1)
    for at in range(0, len(use), TM.AT_ONCE):
        t = use[at:at + TM.AT_ONCE]
        own = np.eye(k)[want[t]]
        p = (of_doc[doc[t]] - own + alpha) * np.maximum(word[places[t]] - own + beta, beta) / (total - own + beta * 49)
        p = np.cumsum(p, axis=1)
        new = (p < (draw.random(len(t)) * p[:, -1])[:, None]).sum(1).clip(max=k - 1)
        np.add.at(of_doc, (doc[t], want[t]), -1)
        np.add.at(word, (places[t], want[t]), -1)
        np.add.at(of_doc, (doc[t], new), 1)
        np.add.at(word, (places[t], new), 1)
        total = total + np.bincount(new, minlength=k) - np.bincount(want[t], minlength=k)
        want[t] = new
    assert (got == want).all() and (block.of_word == word).all()


def test_vectors_of_dealt_texts_are_those_of_the_scan(spark, tmp_path, monkeypatch):
    """F8: pairs made all over the cluster train the vectors that the scan's task would."""
    docs = one_file(spark, tmp_path / "d").where("id is not null and id != 7")
    back = small_parts(spark, monkeypatch)
    try:
        tok = K.stored_tokens(docs, row_col="row")
        monkeypatch.setattr(E, "GROUP_ROWS", 10_000)
        got, old = ({r.word: (r.n, r.vector) for r in E.train(t, size=8, window=3, sample=0, epochs=1, blocks=2, row_col=c).collect()}
                    for t, c in ((tok, "row"), (K.tokens(docs), None)))
        assert got == old and len(got) > 50
        monkeypatch.setattr(E, "GROUP_ROWS", 100)
        coded = tok.select(F.xxhash64("id").alias("text"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("codes"), "row").where("codes is not null")
        none = (np.zeros(0, np.int64), np.zeros(0))
        pairs = E._pairs(coded, none, 2, 3, 7).select(F.spark_partition_id().alias("p")).distinct().count()
        assert pairs > 1
    finally:
        back()


def test_language_batches_are_small(spark):
    """pipeline: a worker splits two megabytes of text at once, whatever Arrow hands it."""
    df = spark.range(0, 400, numPartitions=1).select("id", F.repeat(F.lit("word "), 4000).alias("text"))
    out = T.StructType([T.StructField("rows", T.LongType())])
    sizes = map_batches(df, lambda b: {"rows": [b.num_rows] * b.num_rows}, out, ["id"], langid.SLICE_BYTES).collect()
    assert len(sizes) == 400 and max(r.rows for r in sizes) <= 110


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """one bucket of a keyed table is not one task's however large it is."""
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "id bigint, v string", 1)
    key, old = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = small_parts(spark, monkeypatch)
    spark.conf.set(key, "64kb")
    try:
        rows = spark.range(0, 20_000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
        table.append(rows, ("a", 0))
        table.merge(rows.where("id < 10").withColumn("v", F.lit("new")), ("a", 1))
    finally:
        spark.conf.set(key, old)
        back()
    assert len(table._load({"0": [0]}).inputFiles()) > 1
    assert table.read().count() == 20_000 and table.read().where("v = 'new'").count() == 10


def test_task_texts_are_dealt_out(spark, tmp_path, monkeypatch):
    """the labelled texts of one row group lie in many partitions when the task trains."""
    docs = one_file(spark, tmp_path / "d").where("id is not null and id != 7")
    labels = spark.range(0, 600).select("id", F.pmod("id", F.lit(2)).cast("double").alias("label"))
    seen, fit = [], TP.Pipeline.fit
    monkeypatch.setattr(TP.Pipeline, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    back = small_parts(spark, monkeypatch)
    try:
        done = TP.run_task(docs, labels, 2, size=4, window=3, sample=0, max_iter=2)
    finally:
        back()
    assert seen[0] > 1 and done["predictions"].count() > 50
