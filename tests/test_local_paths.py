"""Paths searched in the tasks against the search over tables."""

import random

from encyclo.operators import graph as G


def test_paths_in_the_tasks(spark, monkeypatch):
    """g3_shortest_paths, g3_path_costs, g4_beam_paths: every round of all pairs went through stored tables and shuffles."""
    rnd = random.Random(3)
    n = 40
    e = [(u, rnd.randrange(n), rnd.choice([0.0, 0.1, 0.2, 0.3])) for u in range(n - 3) for _ in range(4)]
    e += [(5, 5, 0.0), e[0], (*e[1][:2], 0.5)]
    edges = spark.createDataFrame(e, "src long, dst long, cost double")
    asked = [(i, i, (i * 7 + 3) % n) for i in range(0, n, 2)] + [(100, 4, 4), (101, 2, 999), (None, 1, 2), (102, None, 3)]
    vec = spark.createDataFrame([(i, [float(rnd.gauss(0, 1)) for _ in range(5)]) for i in range(n)], "vec_id long, embedding array<float>")
    stored, names = G.stored, []
    monkeypatch.setattr(G, "stored", lambda df, name, by=None: names.append(name) or stored(df, name, by))
    for more, kw in ((asked + [(0, 0, 3), (7, 5, 9)], {}), (asked[:20:4] + asked[20:], dict(vectors=vec, heuristic_weight=4.0, beam=3))):
        pairs = spark.createDataFrame(more, "qid long, source long, target long")
        want = sorted(map(tuple, G.shortest_paths(edges, pairs, **kw).collect()))
        names.clear()
        got = sorted(map(tuple, G.shortest_paths(edges, pairs, local_legs=1000, **kw).collect()))
        assert got == want and got
        assert names == ["path-legs"]
        # a graph that is too large, or costs without a value, go over the tables
        for odd, legs in ((edges, 100), (edges.union(spark.createDataFrame([(1, 2, None)], edges.schema)), 1000)):
            assert G._local(odd, pairs, legs=legs, max_rounds=None, id_col="vec_id", vec_col="embedding",
                            **{"vectors": None, "heuristic_weight": 0.0, "beam": None, **kw}) is None
