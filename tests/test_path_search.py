"""The path search from both ends against Dijkstra, and the size of its state."""

import heapq
import math
import random
from collections import defaultdict

from encyclo.operators import graph as G


def _dijkstra(adj, s, t):
    dist, pq = {s: 0.0}, [(0.0, s)]
    while pq:
        d, u = heapq.heappop(pq)
        if u == t:
            return d
        for v, w in adj[u] if d <= dist[u] else ():
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(pq, (d + w, v))
    return None


def test_paths_from_both_ends(spark, monkeypatch):
    rnd = random.Random(3)
    n = 120
    e = [(u, rnd.randrange(8, n - 5), round(rnd.choice([0.5, 0.6, 0.7]), 6)) for u in range(n) for _ in range(4)]
    e += [(u, 7, 0.4) for u in range(n)] + [e[0], (20, 21, 0.0), (21, 20, 0.0), (119, 119, 0.0)]  # a hub; nodes 115 to 119 are no one's target
    adj = defaultdict(list)
    for u, v, w in e:
        adj[u].append((v, w))
    cost = {}
    for u, v, w in e:
        cost[u, v] = min(w, cost.get((u, v), math.inf))
    asked = [(i, i, (i * 37 + 11) % n) for i in range(0, n - 10, 2)] + [(1000, 5, 5), (1001, 1, 118), (0, 0, 11)]
    rows = []
    stored = G.stored

    def watch(df, name, by=None):
        out = stored(df, name, by)
        if name == "path-state":
            rows.append(out[0].count())
        return out

    monkeypatch.setattr(G, "stored", watch)
    edges = spark.createDataFrame(e, "src long, dst long, cost double")
    pairs = spark.createDataFrame(asked, "qid long, source long, target long")
    got = G.shortest_paths(edges, pairs).collect()
    want = [(q, s, t, d) for q, s, t in asked if (d := _dijkstra(adj, s, t)) is not None]
    assert sorted((r.qid, r.source, r.target) for r in got) == sorted(w[:3] for w in want)
    best = {w[:3]: w[3] for w in want}
    for r in got:
        assert abs(r.cost - best[r.qid, r.source, r.target]) < 1e-9
        assert r.path[0] == r.source and r.path[-1] == r.target and r.hops == len(r.path) - 1 == len(set(r.path)) - 1
        assert abs(sum(cost[a, b] for a, b in zip(r.path, r.path[1:])) - r.cost) < 1e-9
    assert max(rows) < 0.5 * len(asked) * n
