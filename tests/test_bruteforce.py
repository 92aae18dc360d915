"""Operators without a SQL oracle, checked against brute force on small data."""

import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from encyclo.operators import corpus as K
from encyclo.operators import vectors as VO
from encyclo.operators.graph import shortest_paths
from encyclo.sources.fixtures import Tables


def _dijkstra(adj, s, t):
    dist = {s: 0.0}
    pq = [(0.0, s)]
    while pq:
        d, u = heapq.heappop(pq)
        if u == t:
            return d
        if d > dist.get(u, math.inf):
            continue
        for v, w in adj[u]:
            nd = d + w
            if nd < dist.get(v, math.inf):
                dist[v] = nd
                heapq.heappush(pq, (nd, v))
    return None


def test_shortest_paths_match_dijkstra(spark):
    emb = Tables(spark, SF001).embeddings
    edges = VO.knn_graph(emb, k=4).checkpoint()
    e = edges.collect()
    adj = defaultdict(list)
    for r in e:
        adj[r.src].append((r.dst, r.cost))
    ids = sorted(r.vec_id for r in emb.select("vec_id").collect())
    pairs = spark.createDataFrame([(i, ids[i], ids[(i * 7 + 3) % len(ids)]) for i in range(40)],
                                  "qid long, source long, target long")
    got = {r.qid: r for r in shortest_paths(edges, pairs).collect()}
    wmap = {(r.src, r.dst): r.cost for r in e}
    for qid, s, t in pairs.collect():
        exp = _dijkstra(adj, s, t)
        if exp is None:
            assert qid not in got
            continue
        r = got[qid]
        assert math.isclose(r.cost, exp, abs_tol=1e-9)
        assert r.path[0] == s and r.path[-1] == t
        assert math.isclose(sum(wmap[(a, b)] for a, b in zip(r.path, r.path[1:])), r.cost, abs_tol=1e-9)
    # the beam search never beats the exact cost
    beam = {r.qid: r.cost for r in shortest_paths(edges, pairs, vectors=emb, heuristic_weight=4.0,
                                                  beam=5, max_rounds=20).collect()}
    for qid, c in beam.items():
        assert c >= got[qid].cost - 1e-9


def _greedy(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_apply_phrases_matches_greedy_merge(spark):
    tok = K.tokens(Tables(spark, SF001).w_text)
    ph = K.learn_phrases(tok, min_count=2, threshold=3.0)
    phrases = {(r.word_a, r.word_b) for r in ph.collect()}
    assert phrases
    merged = {r.id: list(r.tokens) for r in K.apply_phrases(tok, ph).collect()}
    for r in tok.collect():
        assert merged[r.id] == _greedy(list(r.tokens), phrases)


def test_phrase_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "new york is big new york"), (2, "new york and new york")], "id long, text string")
    tok = K.tokens(docs)
    got = {(r.word_a, r.word_b): (r.pair_count, r.score) for r in K.learn_phrases(tok, 2, 0.0).collect()}
    # unigrams: new 4, york 4, is 1, big 1, and 1 -> 5; bigrams: new york, york is, is big, big new,
    # york and, and new -> 6; |V| = 11; score(new york) = (4 - 2) / (4 * 4) * 11
    assert got == {("new", "york"): (4, round(2 / 16 * 11, 6))}


def test_similar_articles_blocked_equals_single_block(spark):
    emb = Tables(spark, SF001).embeddings
    a = {(r.id, r.rank): (r.neighbor_id, r.similarity) for r in VO.similar_articles(emb, 5).collect()}
    b = {(r.id, r.rank): (r.neighbor_id, r.similarity)
         for r in VO.similar_articles(emb, 5, block_rows=37).collect()}
    assert a == b
    # brute force
    rows = emb.collect()
    M = np.array([np.asarray(r.embedding, dtype=np.float64) for r in rows])
    ids = [r.vec_id for r in rows]
    n = np.linalg.norm(M, axis=1)
    S = np.round(M @ M.T / np.outer(n, n), 6)
    for i, vid in enumerate(ids):
        cand = sorted(((-S[i, j], ids[j]) for j in range(len(ids)) if j != i))[:5]
        for rank, (s, nb) in enumerate(cand, 1):
            assert a[(vid, rank)] == (nb, -s)


def test_word_ids_dense_and_ordered(spark):
    tok = K.tokens(Tables(spark, SF001).w_text)
    w = K.word_ids(tok).orderBy("word_id").collect()
    assert [r.word_id for r in w] == list(range(len(w)))
    words = [r.word for r in w]
    assert words == sorted(words, key=lambda s: s.encode("utf-8"))
    assert tok.select(F.explode("tokens")).distinct().count() == len(w)


def test_similar_articles_filters(spark):
    emb = Tables(spark, SF001).embeddings
    q = spark.range(0, 50).select(F.col("id"))
    c = spark.range(0, 500, 2).select(F.col("id"))
    got = VO.similar_articles(emb, 3, query_ids=q, candidate_ids=c).collect()
    assert {r.id for r in got} == set(range(50))
    assert all(r.neighbor_id % 2 == 0 and r.neighbor_id != r.id for r in got)
    full = {(r.id, r.rank): r.neighbor_id for r in VO.similar_articles(emb, 3, query_ids=q).collect()}
    assert set(full) == {(i, k) for i in range(50) for k in (1, 2, 3)}


def test_similar_approx_reports_only_true_pairs(spark):
    emb = Tables(spark, SF001).embeddings
    rows = emb.collect()
    M = np.array([np.asarray(r.embedding, dtype=np.float64) for r in rows])
    ids = [r.vec_id for r in rows]
    n = np.linalg.norm(M, axis=1)
    S = M @ M.T / np.outer(n, n)
    thr = float(np.sort(S[np.triu_indices(len(ids), 1)])[-200])      # about 200 true pairs
    true = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids))
            if S[i, j] >= thr - 1e-9}
    pos = {v: i for i, v in enumerate(ids)}
    got = VO.similar_approx(emb, thr, bucket_length=1.0, num_tables=8).collect()
    assert got
    for r in got:
        a, b = sorted((r.id, r.neighbor_id))
        assert abs(r.similarity - round(S[pos[a], pos[b]], 6)) < 1e-5
        assert (a, b) in true
    assert len({tuple(sorted((r.id, r.neighbor_id))) for r in got}) >= 0.5 * len(true)


def test_shortest_paths_batched_equals_single(spark):
    emb = Tables(spark, SF001).embeddings
    edges = VO.knn_graph(emb, k=4).checkpoint()
    ids = sorted(r.vec_id for r in emb.select("vec_id").collect())
    pairs = spark.createDataFrame([(i, ids[i], ids[(i * 11 + 5) % len(ids)]) for i in range(30)],
                                  "qid long, source long, target long")
    one = {r.qid: round(r.cost, 9) for r in shortest_paths(edges, pairs).collect()}
    many = {r.qid: round(r.cost, 9) for r in shortest_paths(edges, pairs, pairs_per_batch=8).collect()}
    assert one == many
