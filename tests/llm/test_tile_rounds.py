"""Embedding near-duplicates: tiles in rounds against brute force."""

import os

import numpy as np

from encyclo.llm import embedding
from encyclo.session import ensure_checkpoint_dir


def test_tiles_meet_in_rounds(spark, monkeypatch, tmp_path):
    """op3: all pairs of tiles were sent at once, and every step's table stayed on disk."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 8)) * 0.05, base[:10]]).astype(np.float32)
    rounds = []
    stage = embedding.stage
    monkeypatch.setattr(embedding, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    had = {n: sum(f.startswith(n + "-") for f in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))) for n in ("tiles", "placed", "vectors", "distinct-vectors")}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r[0]: (r[1], r[2]) for r in embedding.links(rows, tile_rows=16).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i][0] for i in range(len(x))] == near.sum(axis=1).tolist()
    part = list(range(len(x)))
    for _ in part:
        part = [min([part[i], *(part[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert [got[i][1] for i in range(len(x))] == part
    assert rounds.count("tile-links") > 2
    left = os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))
    assert all(sum(f.startswith(n + "-") for f in left) == k for n, k in had.items())
