"""Vector codes, Merkle manifests and main texts of pages against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from encyclo.llm import htmltext, merkle, vectorcodes
from encyclo.llm.queries import QUERIES


def write(spark, folder, name, frame):
    frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


# ---- vector codes ---------------------------------------------------------------------

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Rows (vec_id, vector, label) by full scans in Python's integers."""
    kept = [(k, v, lb) for k, v, lb in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts
    cut = [[q[p * w:(p + 1) * w] for p in range(parts)] for q in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(p, y):
        return min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for y in cut:
                own[nearest(p, y[p])[1]].append(y[p])
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(own, books[p])])
        books = new
    found = [[nearest(p, y[p]) for p in range(parts)] for y in cut]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(k, "".join(f"{e:02x}" for _, e in f), err,
                    sum(e2 for (_, _, l2), e2 in zip(kept, errors) if l2 == lb), digest)
                   for (k, _, lb), f, err in zip(kept, found, errors)], key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def test_orchard_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for scale in (3, 40, 10 ** 8):  # few values: many equal distances and equal entries
        book = vectorcodes.Codebook(rng.integers(-scale, scale, size=(64, 4)))
        x = rng.integers(-scale, scale, size=(3000, 4))
        best, dist = book.nearest(x)
        d = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()
    best, dist = vectorcodes.Codebook(np.array([[5]])).nearest(np.array([[7], [5]]))
    assert best.tolist() == [0, 0] and dist.tolist() == [4, 0]


@pytest.mark.parametrize("n", [150, 20, 1])
def test_codes_equal_brute_force(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    vectors = np.round(rng.normal(size=(n, 32)), 2).astype(np.float32)
    rows = [(1000 - 3 * k, v.tolist(), [0, 1, None][k % 3]) for k, v in enumerate(vectors)]
    rows += [rows[0], rows[0], (5, rows[0][1], 7), (None, rows[0][1], 0), (None, [0.0] * 32, None)]
    bad = [(1, None, 0), (2, [float("nan")] + [0.0] * 31, 0), (3, [None] + [0.0] * 31, None), (4, [float("inf")] + [1.0] * 31, 1)]
    write(spark, tmp_path, "embeddings", spark.createDataFrame([(a, b, c, "x", 9) for a, b, c in rows + bad], SCHEMA).repartition(4))
    got = sorted([tuple(r) for r in QUERIES["op13_codes"](spark, str(tmp_path)).collect()], key=str)
    assert got == brute_codes(rows)


def test_codes_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    write(spark, tmp_path, "embeddings", empty)
    assert QUERIES["op13_codes"](spark, str(tmp_path)).collect() == []
    odd = spark.createDataFrame([(1, [], 0), (2, [1.0] * 16, 0), (3, [1e30] * 16, 0), (4, [2.0] * 16, 1)], "vec_id long, embedding array<float>, label int")
    books = vectorcodes.train(odd)
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.encode(odd, books).collect()}
    assert got == {1: (None, None), 2: ("00" * 16, 0), 3: (None, None), 4: ("01" * 16, 0)}
    with pytest.raises(ValueError):
        vectorcodes.train(odd, parts=5)


def test_group_sums_by_salt(spark, monkeypatch):
    frame = spark.createDataFrame([(k, None if k % 3 else k % 2, k) for k in range(300)], "id int, label int, error long")
    want = sorted(map(str, vectorcodes.with_group_sum(frame, "label", "error", "total").collect()))
    monkeypatch.setattr(vectorcodes, "GROUPS_AT_ONCE", 0)
    assert sorted(map(str, vectorcodes.with_group_sum(frame, "label", "error", "total").collect())) == want and len(want) == 300


# ---- Merkle manifest ------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute_merkle(rows):
    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[2], r[3], r[4], text)])

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sorted_rows = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    trees = {s: levels_of([leaf(r, r[1]) for r in sorted_rows[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for g, s in enumerate(order):
        for i, r in enumerate(sorted_rows[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            proof = ""
            for levels, at in ((trees[s], i), (top, g)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3:at // 3 * 3 + 3]
                    a, z = "".join(run[:at % 3]), "".join(run[at % 3 + 1:])
                    now, proof, at = H(a, now, z), proof + a + z, at // 3
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, H(proof), now, now == root))
    return sorted(out, key=str)


def test_addresses_fill_the_block_and_keep_subtrees_together():
    for levels in range(1, 8):
        at = [merkle.address(d, np.arange(3 ** d), levels) for d in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(merkle.n_nodes(levels)))
        top = levels // 2
        for j in range(3 ** top if levels > 1 else 0):  # every lower subtree is one stretch
            own = np.concatenate([at[d][j * 3 ** (d - top):(j + 1) * 3 ** (d - top)] for d in range(top, levels)])
            assert own.max() - own.min() + 1 == len(own) == merkle.n_nodes(levels - top)


DOCS = "doc_id long, text string, source string, lang string, n_chars long, leaf string, _pos int"


@pytest.mark.parametrize("hot", [5, 27, 729, 730, 2300])
def test_merkle_equals_brute_force(spark, tmp_path, hot):
    rnd = random.Random(hot)
    rows = [(k, rnd.choice(["a\nb", "ü€\n\n", "", "x", None, "long " * 2000 + "\n"]), "hot", rnd.choice(["en", None]), k) for k in range(hot)]
    rows += [(10 ** 6 + k, f"t\n{k}", rnd.choice([None, "", "ä", "z", "Z", f"s{k % 17}"]), "de", None) for k in range(60)]
    rows += [(None, "null\n", "hot", None, None), rows[0], rows[0], (-7, "neg\n", "hot", "x", 1), (0, "other", "hot", "x", 1)]
    write(spark, tmp_path, "documents", spark.createDataFrame([(*r, "mine", 1) for r in rows], DOCS).repartition(5))
    got = sorted([tuple(r) for r in QUERIES["op11_merkle"](spark, str(tmp_path)).collect()], key=str)
    assert got == brute_merkle(rows)


def test_merkle_of_one_and_of_none(spark, tmp_path):
    one = spark.createDataFrame([(4, "a\nb", None, None, None, "", 0)], DOCS)
    write(spark, tmp_path, "documents", one)
    (row,) = QUERIES["op11_merkle"](spark, str(tmp_path)).collect()
    assert tuple(row) == brute_merkle([(4, "a\nb", None, None, None)])[0]
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()
    write(spark, tmp_path, "documents", one.limit(0))
    assert QUERIES["op11_merkle"](spark, str(tmp_path)).collect() == []


def test_positions_over_parts(spark):
    """A group over many parts, groups inside one, and a tie over a part's border."""
    frame = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("_g"),
                                     (F.col("id") % 700).alias("_o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = merkle.numbered(frame, ["_o"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for r in rows:
        by.setdefault(r._g, []).append((r._pos, r._o))
    for g, found in by.items():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found))) and [o for _, o in found] == sorted(o for _, o in found)


# ---- main text ------------------------------------------------------------------------

LONG = "A sentence of the story that goes on for quite some time and says something. " * 3
PAGES = {
    "": "", "<p>": "", "<nav><a href=x>Menu</a></nav>": "",
    "<p>a &amp;&nbsp; b<br>c\n d &#233;&hellip; <b>e</b>f</p>": "a & b c d é… ef",
    f"<nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy now, it is cheap, everybody does.</div><article><h1>Head</h1><p><b>{LONG}<br><p>Short."
    f"</p></article><footer>&copy; us</footer>": f"Head\n\n{LONG.strip()}\n\nShort.",
    f"<body><header>Site</header><div id=cookie-notice><p>{LONG}</p></div><main><article><header><h1>T</h1><p>By me</p></header><p>{LONG}</p>"
    f"<aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class='inline-advert'>{LONG}</div><p>x <span class=ad>ad</span>y<script>z</script></p>"
    f"<table><tr><td>1<td>2</table></article><section id='comments'><article class='comment'><p>{LONG}</p></article></section></main>":
        f"T\n\n{LONG.strip()}\n\nx y\n\n1\n\n2",
    f"<html class='has-sidebar'><body class='menu'><div class='layout-sidebar'><main><p>{LONG}</p><p>End</main></div>": f"{LONG.strip()}\n\nEnd",
    f"<div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class=story><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div><a href=c>More</a></div>":
        f"{LONG.strip()}\n\nTiny.\n\n{LONG.strip()}",
    f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>": f"{LONG.strip()}\n\n{LONG.strip()}",
    f"<article><p>{LONG}<script>if (a<b) '</p>'": LONG.strip(),
    f"<head><title>T</title><article>{LONG}</b></div></span></article><![weird]]> <!-- c": LONG.strip(),
}


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text(k):
    html, want = list(PAGES.items())[k]
    assert htmltext.main_text(html) == want


def test_smoothing_is_a_weighted_mean():
    x = np.array([0.0, 10.0, 0.0, 0.0, 0.0, 5.0])
    w = [math.exp(-k * k / 2) for k in range(3)]
    want = [sum(x[j] * w[abs(i - j)] for j in range(6) if abs(i - j) <= 2) / sum(w[abs(i - j)] for j in range(6) if abs(i - j) <= 2)
            for i in range(6)]
    assert np.allclose(htmltext.smooth(x), want) and np.allclose(htmltext.smooth(np.ones(1)), [1.0])


def test_html_query(spark, tmp_path):
    schema = "page_id long, url string, html string, text int, n_chars string"
    long = "<article><p>" + "word &amp; " * 300_000 + "</p>" + "<p>x</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article>é</article>"), (4, "w", "<article>é</article>"), (4, "w", "<article>é</article>"), (5, "l", long)]
    write(spark, tmp_path, "pages", spark.createDataFrame([(*r, 7, "x") for r in rows], schema))
    got = [tuple(r) for r in QUERIES["op12_html"](spark, str(tmp_path)).collect()]
    want = [(a, b, t := htmltext.main_text(c), len(t)) for a, b, c in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and {t for _, _, t, _ in got} >= {"", "é"}
    assert want[-1][2] == ("word & " * 300_000).strip() + "\n\nx" * 20_000
    write(spark, tmp_path, "pages", spark.createDataFrame([], schema))
    assert QUERIES["op12_html"](spark, str(tmp_path)).collect() == []
