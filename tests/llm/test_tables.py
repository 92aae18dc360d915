"""Operators on vectors and pages against brute force, and the pipeline."""

import gzip
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from encyclo.llm import embedding, urls, warc
from encyclo.llm.components import merge_labels


# ---- embeddings -------------------------------------------------------------------

def brute_links(rows, threshold=0.9):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    count, labels = np.zeros(len(rows), int), np.arange(len(rows))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for (_, v), u in zip(rows, usable)]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                count[i] += 1
                labels = merge_labels(labels, np.array([i]), np.array([j]))
    low = {k: min((rows[i][0] for i in range(len(rows)) if labels[i] == k and rows[i][0] is not None), default=None) for k in set(labels.tolist())}
    return sorted([(r[0], int(c), low[int(k)]) for r, c, k in zip(rows, count, labels)], key=str)


@pytest.mark.parametrize("tile_rows", [4096, 20])
def test_embedding_links(spark, tile_rows):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[:12] + rng.normal(size=(12, 16)) * s for s in (0.05, 0.1, 0.15, 0.2)])
    many = base[0] + rng.normal(size=(60, 16)) * 0.02
    vectors = np.concatenate([base, near, many]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15),
             (1006, rows[3][1]), (1007, [-0.0] + [1.0] * 15), (1008, [0.0] + [1.0] * 15), (1009, [1.0, 0.0]), (1010, [2.0, 0.1]), (1011, [x * 3 for x in rows[5][1]]), (None, rows[7][1])]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, id string, n_links int")
    got = sorted([tuple(r) for r in embedding.links(frame, tile_rows=tile_rows).collect()], key=str)
    assert got == brute_links(rows)
    assert embedding.links(frame.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(9)
    x = embedding.unit_rows(rng.normal(size=(300, 64)) * rng.exponential(size=(300, 64)) ** 3)
    q, s, length, err = embedding.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(approx - x @ x.T) <= length[:, None] * err[None, :] + err[:, None]).all()


# ---- urls -----------------------------------------------------------------------------

def brute_judge(rows, rules=urls.RULES):
    counts: dict = {}
    for _, _, html in rows:
        for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", html or "").lower()):
            if len(w) <= urls.MAX_WORD:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) or 1
    judged = []
    for page, url, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        tokens = ["host " + w for run in re.findall(r"[^\W\d_]+", host) for w in urls.best_split(run, counts, total)]
        tokens += ["path " + t for t in re.findall(r"[^\W_]+", path.lower())]
        judged.append((page, host, path, max(fits, default=(0, None, None)), tokens))
    sums = {"block": {}, "allow": {}}
    n = {"block": 0, "allow": 0}
    for *_, (_, _, v), tokens in judged:
        if v:
            n[v] += 1
            for t in tokens:
                sums[v][t] = sums[v].get(t, 0) + 1
    size = len(set(sums["block"]) | set(sums["allow"]))
    weight = lambda v, t: math.log((sums[v].get(t, 0) + 1) / (sum(sums[v].values()) + size + 1))
    out = []
    for page, host, path, (_, rule, verdict), tokens in judged:
        score = None if verdict else math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(weight("block", t) - weight("allow", t) for t in tokens)
        out.append((page, host, path, rule, verdict or ("block" if score > 0 else "allow"), score))
    return out


def test_url_judgements(spark):
    text = "<p>cheap pills</p> casino win the example blog cheap <b>the</b>"
    rows = [(1, "https://a.example.org/x", text), (2, "http://Example.org/es/1", text), (3, "https://b.example.org/en/12?x#y", None),
            (4, "https://shop.com/fr/", ""), (5, "https://cheappills.com/de/buy", text), (6, "https://cheappills.net/de/buy", "x"),
            (7, "https://blog.casinowin.net", text), (8, None, None), (9, "no scheme", "y"), (10, "x://example.org", ""), (11, "x://HOST:80?a/b", ""),
            (12, "https://notorg/", ""), (13, "https://org/", ""), (7, "https://blog.casinowin.net", text), (14, "ftp://ex.net/es/?https://a.org/", ""),
            (None, "https://q.com/de", ""), (15, "a\n://b.org/\nz", "")]
    frame = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = sorted([tuple(r) for r in urls.judge(frame).collect()], key=str)
    want = sorted(brute_judge(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all((g[5] is None) == (w[5] is None) and (g[5] is None or abs(g[5] - w[5]) < 1e-9) for g, w in zip(got, want))
    assert urls.judge(frame.limit(0)).count() == 0


def test_url_rule_prefers_longest(spark):
    rules = {("example.org", "/es/1"): ("example.org/es/", "block"), ("a.example.org", "/en/12"): ("example.org/en/1", "block"),
             ("example.org", "/fr/"): ("org/", "allow"), ("org", ""): None, ("com", "/de/x"): ("com/de/", "block")}
    frame = spark.createDataFrame(list(rules), "h string, p string").select("h", "p", urls.rule_for(F.col("h"), F.col("p")).alias("r"))
    assert {(r.h, r.p): r.r and tuple(r.r) for r in frame.collect()} == rules


def test_best_split():
    counts = {"cheap": 5, "pills": 4, "pill": 2, "s": 1}
    assert urls.best_split("cheappills", counts, 100) == ["cheap", "pills"]
    assert urls.best_split("zzz", counts, 100) == ["zzz"] and urls.best_split("", counts, 100) == []


# ---- WARC --------------------------------------------------------------------------------

HTML = ('<!DOCTYPE html><html><head><title> A &amp; B </title><script>var t="</p>";</script></head><body><header>Top</header>'
        '<p>One &lt;two&gt;</p><!-- gone --><div>Three<br>é <a href="/x">x</a> <A class=c HREF="y?a=1&amp;b">y</A></div></body></html>')


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.org/", HTML), (2, None, None), (None, "https://b.org/", ""), (3, "u", "plain\r\n\r\ntext " * 3000), (1, "https://a.org/", HTML)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")


def test_warc_derivatives(spark, pages):
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    made = warc.derive(warc.responses(pages)).collect()
    assert len(made) == 10 and len(sources) == 4
    for r in made:
        source = sources[r.headers["WARC-Refers-To"]]
        assert r.headers["WARC-Target-URI"] == source.headers["WARC-Target-URI"] and r.headers["WARC-Date"] == source.headers["WARC-Date"]
        assert r.headers["WARC-Source-Payload-Digest"] == source.headers["WARC-Payload-Digest"]
        assert int(r.headers["Content-Length"]) == len(r.block)
    text = {r.id: bytes(r.block).decode() for r in made if r.type == "conversion"}
    assert text[1] == "Top\nOne <two>\nThree\né x y" and text[2] == "" and text[None] == ""
    import json
    meta = {r.id: json.loads(bytes(r.block)) for r in made if r.type == "metadata"}
    assert meta[1]["title"] == "A & B" and meta[1]["links"] == ["/x", "y?a=1&amp;b"]
    assert meta[1]["http_headers"].startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_round_trip(spark, pages, tmp_path):
    records = warc.responses(pages).unionByName(warc.derive(warc.responses(pages)))
    members = [bytes(r.member) for r in warc.serialise(records).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:8]))
    (tmp_path / "b.warc").write_bytes(b"".join(map(gzip.decompress, members[8:])))
    back = warc.read_records(spark, str(tmp_path))
    key = lambda rows: sorted((r.record_id, r.type, sorted(r.headers.items()), bytes(r.block)) for r in rows)
    assert key(back.collect()) == key(records.collect())
    assert warc.derive(back).count() == 10


# ---- pipeline ------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import hashlib
    import random

    import corpus_pipeline
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item, whole = text(80), text(40), text(150)
    texts = {1: whole, 2: whole, 3: text(60) + " " + passage, 4: passage + " " + text(60), 5: text(20) + " " + item, 6: None, 7: "123 !!", 8: text(400), 9: "Ünï " + text(90)}
    rows = [(k, t, None if k == 8 else "aa", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.collect()})
    assert seen == [{1, 2, 3, 4, 5, 8, 9}, {1, 3, 4, 5, 8, 9}, {1, 3, 4, 5, 8, 9}, {1, 3, 4, 8, 9}]
    left = {r.doc_id: r for r in docs.collect()}
    assert left[8].lang == "aa" and left[3].text == texts[3] and len(left[4].text.split()) <= 65 and left[4].n_chars == len(left[4].text)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == seen[-1]
    for k, r in out.items():
        assert r.n_tokens == len(r.ids) > 0 and r.decoded_sha256 == hashlib.sha256(left[k].text.encode()).hexdigest()


def test_entry_registers_all():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert {"op1_decontaminate", "op6_warc"} <= set(entry.oracle_sql())


def test_http_parts_of_raw_utf8_headers(spark):
    rows = [("HTTP/1.1 200 OK\r\nX: РРа".encode() + b"\r\n\r\n" + "<p>é\r\n\r\nb".encode(),), (b"no end",), (b"\r\n\r\n",), (b"",), (None,)]
    head, body = warc.http_parts(F.col("block"))
    got = spark.createDataFrame(rows, "block binary").select(head.alias("head"), body.alias("body")).collect()
    assert [(r.head, None if r.body is None else bytes(r.body)) for r in got] == [
        ("HTTP/1.1 200 OK\r\nX: РРа", "<p>é\r\n\r\nb".encode()), ("no end", b""), ("", b""), ("", b""), (None, None)]


WITHOUT_PACKAGE = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def missing(batches):
    import importlib.util
    for b in batches:
        yield b.set_column(0, "id", b.column(0)) if importlib.util.find_spec("encyclo") is None else b.slice(0, 0)

assert spark.range(3).mapInArrow(missing, "id long").count() == 3
sys.path.insert(0, ROOT)
from encyclo.llm import decontaminate, langid
words = " ".join(f"w{k}" for k in range(30))
docs = spark.createDataFrame([(1, words, "en"), (2, "der die das und", "de"), (3, None, None)], "doc_id long, text string, lang string")
benchmark = spark.createDataFrame([(7, words[3:70])], "item_id long, text string")
found = decontaminate.verdict(decontaminate.mark(docs, benchmark)).orderBy("doc_id").collect()
assert [r.contaminated for r in found] == [True, False, False], found
said = langid.predict(docs, langid.train(docs)).orderBy("doc_id").collect()
assert [r.lang_pred for r in said] == ["en", "de", "und"], said
print("done")
"""


def test_workers_without_the_package(tmp_path):
    """The driver has the package, its workers cannot import it."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(f"ROOT = {root!r}\n" + WITHOUT_PACKAGE)
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.endswith("done\n"), done.stderr[-3000:]
