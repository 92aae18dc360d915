"""Top-k search over tiles against brute force, and how often it sends a row."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from encyclo.operators import vectors as VO


def _rows(n, equal):
    v = np.random.default_rng(5).normal(size=(n, 8)).astype(np.float32)
    v[10:10 + equal] = v[10]
    v[3], v[4, 2] = 0, np.nan
    return v


@pytest.mark.parametrize("equal", [0, 3000])
@pytest.mark.parametrize("signs", [None, (1, 1, -1), (1, 1), (-1,)])
def test_kernel_equals_brute_force_over_many_tiles(equal, signs):
    n, nq, k = 9001, 60, 4
    v = _rows(n, equal)
    ids = np.arange(n, dtype=np.int64) * 2
    terms = [v[np.arange(nq) + j] for j in range(len(signs or (1,)))]
    c = pa.table({"cid": ids, "vec": pa.array(list(v))})
    q = {"qid": ids[:nq], "exclude": pa.array([[int(i), int(i) + 2] for i in ids[:nq]])}
    if signs is None:
        q["vec"] = pa.array(list(terms[0]))
    else:
        q["terms"] = pa.array([[t[i].tolist() for t in terms] for i in range(nq)], pa.list_(pa.list_(pa.float32())))
        q["signs"] = pa.array([list(signs)] * nq)
    got = VO._kernel("cosine" if signs is None else "cosmul", k, 1e-3)(None, pa.table(q), c).to_pylist()
    v = v.astype(float)
    with np.errstate(all="ignore"):
        cos = [(t.astype(float) @ v.T) / np.outer(np.linalg.norm(t.astype(float), axis=1), np.linalg.norm(v, axis=1)) for t in terms]
        if signs is None:
            S = cos[0]
        else:
            num = den = 1.0
            for s, x in zip(signs, cos):
                num, den = (num * (1 + x) / 2, den) if s > 0 else (num, den * (1 + x) / 2)
            S = num / (den + 1e-3) * np.ones((nq, n))
    S = np.round(S, 6)
    found = defaultdict(list)
    for r in got:
        found[r["qid"]].append((-r["score"], r["cid"]))
    for i in range(nq):
        ok = [j for j in np.flatnonzero(np.isfinite(S[i])) if ids[j] not in (ids[i], ids[i] + 2)]
        want = sorted((-S[i, j], int(ids[j])) for j in ok)[:k]
        have = sorted(found[int(ids[i])])
        assert len(have) == len(want)
        # the last digit may fall either way
        assert all(abs(a[0] - b[0]) < 1.5e-6 for a, b in zip(have, want))


def test_copies_of_the_vectors_grow_slowly():
    # each row is sent once to every block of the other side
    assert VO._blocks(600_000, 64, None) <= 10
    assert VO._blocks(600_000, 64 * 3, None) <= 15
    assert VO._blocks(100, 64, None) == 1 and VO._blocks(600_000, 10_000, None) > 600
