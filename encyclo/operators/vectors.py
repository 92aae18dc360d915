"""Vector search: exact blocked top-k similarity, analogies, class vectors.

Exact top-k without a cross join
--------------------------------
Queries and candidates are hashed into blocks of at most ``BLOCK_ROWS`` rows (and
``BLOCK_BYTES`` bytes of vectors).  Every query row is replicated to each candidate
block (``explode(sequence)``, a narrow step) and every candidate row to each query
block; a cogroup on ``(query_block, candidate_block)`` hands one block pair to a
numpy kernel.  The kernel goes through the pair in tiles: a matrix product in single
precision leaves out the pairs that cannot reach the k best found so far, by more than
its rounding error; the others are scored in double precision.  Only the top-k per
query of a block pair are emitted.  A final ``row_number() <= k`` (planned with a
partial WindowGroupLimit) merges the per-block lists.  No task ever holds more than
two blocks and a tile, whatever the key distribution; pairs are never emitted as rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

ROUND = 6
_OUT = T.StructType([T.StructField("qid", T.LongType()), T.StructField("cid", T.LongType()),
                     T.StructField("score", T.DoubleType())])


BLOCK_ROWS = 65_536
BLOCK_BYTES = 64 << 20  # vectors of one block, eight bytes a component
LEAST_BLOCKS, SMALL_BLOCK = 4, 2048  # blocks a side for the sake of tasks, unless they hold fewer rows
TILE_QUERIES, TILE_CANDIDATES, FIRST_TILE = 256, 4096, 256  # the first tile only sets a bar for the others
RESCORED = 1 << 16  # pairs scored in double precision at once


def _mat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column as a matrix in double precision; null components are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(len(column), 1)
    if len(column) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), width)


def _unit(M: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the rows by their norms in single precision (NaN for zero or non-finite rows)."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        n = np.sqrt((M * M).sum(axis=1))
        return n, (M / n[:, None]).astype(np.float32)


class _Best:
    """The k best (score, smaller id first) candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.cid, self.k = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), k

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, row: np.ndarray, cid: np.ndarray, score: np.ndarray) -> None:
        ok = np.isfinite(score)
        row, cid, score = row[ok], cid[ok], score[ok]
        if not len(row):
            return
        hit = np.unique(row)
        old = np.isfinite(self.score[hit])
        row = np.concatenate([np.repeat(hit, old.sum(1)), row])
        cid = np.concatenate([self.cid[hit][old], cid])
        score = np.concatenate([self.score[hit][old], score])
        order = np.lexsort((cid, -score, row))
        row, cid, score = row[order], cid[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.score[hit], self.cid[hit] = -np.inf, -1
        self.score[row[keep], rank[keep]], self.cid[row[keep], rank[keep]] = score[keep], cid[keep]


def _search(terms: list[np.ndarray], signs: tuple[int, ...] | None, C: np.ndarray, cid: np.ndarray, k: int, eps: float,
            exclude: list | None) -> _Best:
    """Best candidates of queries with one vector (cosine) or with ``terms`` of the given ``signs`` (3CosMul)."""
    n, best = len(terms[0]), _Best(len(terms[0]), k)
    cn, cu = _unit(C)
    units = [_unit(t) for t in terms]
    # a cosine in single precision is off by less than this
    off = (C.shape[1] + 8) * 2.0 ** -23
    if signs is not None:
        # half of (1 + cosine) straight from the matrix product
        cu = np.concatenate([cu, np.ones((len(cu), 1), np.float32)], axis=1)
        units = [(m, np.concatenate([u * np.float32(0.5), np.full((len(u), 1), 0.5, np.float32)], axis=1)) for m, u in units]
    plus = [j for j in range(len(terms)) if signs is None or signs[j] > 0]
    minus = [j for j in range(len(terms)) if signs is not None and signs[j] < 0]
    more, less = 2 * off * len(plus), 2 * off * len(minus)
    cut = signs is None or eps > 4 * less  # else the quotient is too steep for single precision

    def exact(cos) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if signs is None:
                s = cos(0)
            else:
                num = den = 1.0
                for j in plus:
                    num = num * ((1.0 + cos(j)) / 2.0)
                for j in minus:
                    den = den * ((1.0 + cos(j)) / 2.0)
                s = num / (den + eps)
        return np.round(s, ROUND)

    def pairs(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return exact(lambda j: np.einsum("ij,ij->i", terms[j][r], C[c]) / (units[j][0][r] * cn[c]))

    def tile(q0: int, q1: int, c0: int, c1: int) -> np.ndarray:
        return exact(lambda j: (terms[j][q0:q1] @ C[c0:c1].T) / (units[j][0][q0:q1, None] * cn[None, c0:c1]))

    place = {v: i for i, v in enumerate(cid.tolist())}
    for q0 in range(0, n, TILE_QUERIES):
        q1 = min(q0 + TILE_QUERIES, n)
        left_out = {(r, place[e]) for r, ids in enumerate([] if exclude is None else exclude[q0:q1])
                    for e in ids or () if e in place}
        out = np.array(sorted(left_out, key=lambda x: x[1]), np.int64).reshape(-1, 2)
        cuts = [0, *range(min(FIRST_TILE, len(cid)), len(cid), TILE_CANDIDATES), len(cid)]
        for c0, c1 in zip(cuts, cuts[1:]):
            gone = out[np.searchsorted(out[:, 1], c0):np.searchsorted(out[:, 1], c1)]
            least = best.least[q0:q1]
            r = None
            if cut and c0:
                bar = (least - 2.1 * 10.0 ** -ROUND).astype(np.float32)
                with np.errstate(invalid="ignore", over="ignore"):
                    up = units[plus[0]][1][q0:q1] @ cu[c0:c1].T if plus else np.ones((q1 - q0, c1 - c0), np.float32)
                    for j in plus[1:]:
                        up *= units[j][1][q0:q1] @ cu[c0:c1].T
                    if signs is None:
                        mask = up >= (bar - np.float32(2 * off))[:, None]
                    else:
                        down = units[minus[0]][1][q0:q1] @ cu[c0:c1].T if minus else np.ones((q1 - q0, c1 - c0), np.float32)
                        for j in minus[1:]:
                            down *= units[j][1][q0:q1] @ cu[c0:c1].T
                        # score >= bar, with the numerator and denominator moved by their errors
                        bar = np.where(bar > 0, bar * np.float32(1 - 1e-6), np.float32(-np.inf))
                        down += np.float32(eps - less)
                        down *= bar[:, None]
                        down -= np.float32(more)
                        mask = up >= down
                mask[gone[:, 0], gone[:, 1] - c0] = False
                if np.count_nonzero(mask) <= mask.size // 50:
                    r, c = np.divmod(np.flatnonzero(mask), c1 - c0)
                    for i in range(0, len(r), RESCORED):
                        rr, cc = r[i:i + RESCORED] + q0, c[i:i + RESCORED] + c0
                        best.add(rr, cid[cc], pairs(rr, cc))
            if r is None:
                S = tile(q0, q1, c0, c1)
                S[~np.isfinite(S)] = -np.inf
                S[gone[:, 0], gone[:, 1] - c0] = -np.inf
                bar = best.least[q0:q1]
                if k < S.shape[1]:
                    bar = np.maximum(bar, np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k])
                for i in range(q1 - q0):  # a row at a time: equal scores may be many
                    c = np.flatnonzero(np.isfinite(S[i]) & (S[i] >= bar[i]))
                    if len(c):
                        best.add(np.full(len(c), q0 + i), cid[c0:c1][c], S[i][c])
    return best


def _kernel(mode: str, k: int, eps: float):
    def run(_key, q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and c.num_rows:
            C, cid = _mat(c["vec"]), c["cid"].to_numpy()
            if mode == "cosine":
                groups = {None: np.arange(q.num_rows)}
            else:  # cosmul: queries of equal signs together
                groups = {}
                for i, s in enumerate(q["signs"].to_pylist()):
                    groups.setdefault(tuple(s), []).append(i)
            for signs, rows in groups.items():
                part = q if signs is None else q.take(pa.array(rows))
                qid = part["qid"].to_numpy()
                if signs is None:
                    terms = [_mat(part["vec"])]
                else:
                    every = _mat(part["terms"].combine_chunks().flatten())
                    terms = [np.ascontiguousarray(every[j::len(signs)]) for j in range(len(signs))]
                best = _search(terms, signs, C, cid, k, eps, part["exclude"].to_pylist() if "exclude" in part.column_names else None)
                r, at = np.nonzero(np.isfinite(best.score))
                found.append((qid[r], best.cid[r, at], best.score[r, at]))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
                for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(_OUT.names, cols)))
    return run


def _blocks(n: int, width: int, block_rows: int | None) -> int:
    if block_rows is None:
        block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
        return max(math.ceil(n / block_rows), min(LEAST_BLOCKS, math.ceil(n / SMALL_BLOCK)), 1)
    return max(1, math.ceil(n / block_rows))


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, mode: str = "cosine",
          eps: float = 1e-3, block_rows: int | None = None) -> DataFrame:
    """Exact top-k candidates per query: (qid, cid, score, rank).

    ``queries``: ``qid`` plus ``vec`` (mode 'cosine') or ``terms``/``signs``
    (mode 'cosmul'), optional ``exclude`` (array of candidate ids).
    ``candidates``: ``cid, vec``.  Scores are rounded to 6 digits; ties go to
    the smaller candidate id.  ``block_rows``: rows a block, by default as many
    as ``BLOCK_ROWS`` and ``BLOCK_BYTES`` allow.
    """
    nc, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    if mode == "cosine":
        nq, terms = queries.count(), 1
    else:
        nq, terms = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("terms")), F.lit(1))).first()
    bq, bc = _blocks(nq, width * max(terms, 1), block_rows), _blocks(nc, width, block_rows)
    qcols = [c for c in ("qid", "vec", "terms", "signs", "exclude") if c in queries.columns]
    # fresh attribute ids on both sides: they often derive from the same table
    q = (queries.select(*[F.col(x).alias(x) for x in qcols])
         .withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int"))
         .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(bc - 1)).cast("array<int>"))))
    c = (candidates.select(F.col("cid").alias("cid"), F.col("vec").alias("vec"))
         .withColumn("_cb", F.pmod(F.xxhash64("cid"), F.lit(bc)).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)).cast("array<int>"))))
    # both sides must group on identically typed keys, or the cogroup pairs
    # different hash partitions
    part = (q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb"))
            .applyInArrow(_kernel(mode, k, eps), schema=_OUT))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid"))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vecs(vectors: DataFrame, id_col: str, vec_col: str, as_: str = "cid") -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias(as_), F.col(vec_col).alias("vec"))


def similar_articles(vectors: DataFrame, k: int = 10, id_col: str = "vec_id",
                     vec_col: str = "embedding", block_rows: int | None = None,
                     query_ids: DataFrame | None = None, candidate_ids: DataFrame | None = None) -> DataFrame:
    """All-pairs: the k most similar other articles of every article:
    (id, neighbor_id, rank, similarity).

    ``query_ids`` (column ``id``) restricts the articles that get neighbours,
    e.g. those with at least five words; ``candidate_ids`` restricts the
    neighbours, e.g. to titled articles.  Both are semi-joins before blocking.
    """
    cand = _vecs(vectors, id_col, vec_col)
    q = cand.select(F.col("cid").alias("qid"), "vec", F.array(F.col("cid")).alias("exclude"))
    if query_ids is not None:
        q = q.join(query_ids.select(F.col("id").cast("long").alias("qid")), "qid", "left_semi")
    if candidate_ids is not None:
        cand = cand.join(candidate_ids.select(F.col("id").cast("long").alias("cid")), "cid", "left_semi")
    r = top_k(q, cand, k, block_rows=block_rows)
    return r.select(F.col("qid").alias("id"), F.col("cid").alias("neighbor_id"), "rank",
                    F.col("score").alias("similarity"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, *, qid: str = "qid",
            qvec: str = "vec", id_col: str = "vec_id", vec_col: str = "embedding",
            exclude: str | None = None) -> DataFrame:
    """(qid, id, rank, similarity): the k nearest vectors of each query vector."""
    cols = [F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("vec")]
    if exclude:
        cols.append(F.col(exclude).alias("exclude"))
    r = top_k(queries.select(*cols), _vecs(vectors, id_col, vec_col), k)
    return r.select("qid", F.col("cid").alias("id"), "rank", F.col("score").alias("similarity"))


def class_vectors(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(label, vec): mean vector per class (Summarizer: partial aggregation, one
    running vector per class per task)."""
    return (vectors.groupBy(label_col)
            .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
            .select(label_col, vector_to_array("_m").alias("vec")))


def _question_vectors(questions: DataFrame, vectors: DataFrame, cols: list[str],
                      id_col: str, vec_col: str) -> DataFrame:
    out = questions
    for c in cols:
        v = vectors.select(F.col(id_col).alias(c), F.col(vec_col).alias(f"{c}_vec"))
        out = out.join(v, c, "inner")
    return out


def analogy(questions: DataFrame, vectors: DataFrame, k: int = 1, *, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """a : b :: c : ?  additive: nearest to unit(b) + unit(c) - unit(a), inputs excluded.
    ``questions(qid, a, b, c)`` -> (qid, answer, rank, similarity)."""
    qv = _question_vectors(questions, vectors, ["a", "b", "c"], id_col, vec_col)
    target = V.add(V.add(V.unit("b_vec"), V.unit("c_vec")), V.unit("a_vec"), 1.0, -1.0)
    q = qv.select(F.col("qid").cast("long").alias("qid"), target.alias("vec"),
                  F.array(F.col("a").cast("long"), F.col("b").cast("long"), F.col("c").cast("long")).alias("exclude"))
    r = top_k(q, _vecs(vectors, id_col, vec_col), k)
    return r.select("qid", F.col("cid").alias("answer"), "rank", F.col("score").alias("similarity"))


def cosmul(questions: DataFrame, vectors: DataFrame, k: int = 1, eps: float = 1e-3, *,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """a : b :: c : ?  by 3CosMul (Levy & Goldberg 2014): positives b, c; negative a."""
    qv = _question_vectors(questions, vectors, ["a", "b", "c"], id_col, vec_col)
    q = qv.select(F.col("qid").cast("long").alias("qid"),
                  F.array("b_vec", "c_vec", "a_vec").alias("terms"),
                  F.array(F.lit(1), F.lit(1), F.lit(-1)).alias("signs"),
                  F.array(F.col("a").cast("long"), F.col("b").cast("long"), F.col("c").cast("long")).alias("exclude"))
    r = top_k(q, _vecs(vectors, id_col, vec_col), k, mode="cosmul", eps=eps)
    return r.select("qid", F.col("cid").alias("answer"), "rank", F.col("score").alias("score"))


def word_algebra(queries: DataFrame, vectors: DataFrame, eps: float = 1e-3, *,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Best word for ``queries(qid, positives array<id>, negatives array<id>)``:
    3CosMul when there are positives, else the word nearest to minus the mean
    of the negatives' unit vectors (additive).  Input words are excluded."""
    terms = (queries.select("qid", F.posexplode(F.concat(
        F.transform("positives", lambda x: F.struct(x.cast("long").alias("w"), F.lit(1).alias("s"))),
        F.transform("negatives", lambda x: F.struct(x.cast("long").alias("w"), F.lit(-1).alias("s")))))
        .alias("pos", "t"))
        .select("qid", "pos", F.col("t.w").alias("w"), F.col("t.s").alias("s")))
    tv = terms.join(vectors.select(F.col(id_col).cast("long").alias("w"), F.col(vec_col).alias("v")), "w")
    # a query with an unknown word is refused: all its words must have been found
    asked = queries.select("qid", (F.size("positives") + F.size("negatives")).alias("_asked"))
    # one query's own terms only: bounded by the query length
    g = (tv.groupBy("qid")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "s", "w", "v"))).alias("t"),
              F.max("s").alias("_maxs"))
         .join(asked, "qid").where(F.size("t") == F.col("_asked")).drop("_asked"))
    cand = _vecs(vectors, id_col, vec_col)
    mul = g.where(F.col("_maxs") > 0).select(
        F.col("qid").cast("long").alias("qid"), F.col("t.v").alias("terms"), F.col("t.s").alias("signs"),
        F.col("t.w").alias("exclude"))
    r1 = top_k(mul, cand, 1, mode="cosmul", eps=eps)
    neg = g.where(F.col("_maxs") < 0).select(
        F.col("qid").cast("long").alias("qid"),
        F.aggregate(F.transform("t.v", lambda v: V.unit(v)),
                    F.array_repeat(F.lit(0.0), F.size(F.col("t.v")[0])),
                    lambda acc, u: F.zip_with(acc, u, lambda x, y: x - y)).alias("vec"),
        F.col("t.w").alias("exclude"))
    r2 = top_k(neg, cand, 1)
    return r1.unionByName(r2).select("qid", F.col("cid").alias("answer"), "score")


def outlier(groups: DataFrame, vectors: DataFrame, *, group_col: str = "label",
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Odd one out per group: the member least similar to the mean of the unit vectors."""
    members = groups.select(group_col, id_col).join(vectors.select(id_col, vec_col), id_col)
    unitv = members.select(group_col, id_col, V.unit(vec_col).alias("u"))
    means = class_vectors(unitv, group_col, "u").withColumnRenamed("vec", "m")
    scored = unitv.join(means, group_col).select(group_col, id_col, F.round(V.cosine("u", "m"), ROUND).alias("sim"))
    return (scored.groupBy(group_col)
            .agg(F.min_by(F.struct(id_col, "sim"), F.struct("sim", id_col)).alias("o"))
            .select(group_col, F.col(f"o.{id_col}").alias(id_col), F.col("o.sim").alias("similarity")))


MAX_CLASSES = 100_000


def category_distribution(queries: DataFrame, classes: DataFrame, *, qid: str = "vec_id",
                          qvec: str = "embedding", label_col: str = "label") -> DataFrame:
    """(qid, label, dot, cosine) of every query against every class vector.

    The class table is checked to be small, then passed to every row as one
    scalar-subquery value (no cross join plan); each row scores all classes in
    one ``transform``.
    """
    n = classes.limit(MAX_CLASSES + 1).count()
    if n > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    packed = classes.select(F.collect_list(F.struct(F.col(label_col).alias("l"), F.col("vec").alias("v")))).scalar()
    per = queries.select(F.col(qid).alias("qid"), qvec, packed.alias("_cls")).select(
        "qid", F.explode(F.transform(
        "_cls", lambda c: F.struct(c["l"].alias("label"), V.dot(qvec, c["v"]).alias("dot"),
                                   V.cosine(qvec, c["v"]).alias("cos")))).alias("x"))
    return per.select("qid", F.col("x.label").alias(label_col),
                      F.round("x.dot", ROUND).alias("dot"), F.round("x.cos", ROUND).alias("cosine"))


def analogy_accuracy(questions: DataFrame, vectors: DataFrame, **kw) -> DataFrame:
    """Share of ``questions(qid, a, b, c, d)`` whose additive answer is ``d``."""
    ans = analogy(questions.select("qid", "a", "b", "c"), vectors, 1, **kw)
    j = questions.select("qid", "d").join(ans.select("qid", "answer"), "qid", "left")
    return j.agg(F.count(F.lit(1)).alias("n_questions"),
                 F.sum((F.col("answer") == F.col("d")).cast("int")).cast("long").alias("n_correct")
                 ).select("n_questions", F.coalesce("n_correct", F.lit(0)).alias("n_correct"),
                          F.round(F.col("n_correct") / F.col("n_questions"), ROUND).alias("accuracy"))


def knn_graph(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(src, dst, cost): each node's k most similar other nodes, cost 1 - cos."""
    s = similar_articles(vectors, k, id_col, vec_col)
    return s.select(F.col("id").alias("src"), F.col("neighbor_id").alias("dst"),
                    F.round(1.0 - F.col("similarity"), ROUND).alias("cost"))


def similar_approx(vectors: DataFrame, threshold: float, id_col: str = "vec_id",
                   vec_col: str = "embedding", bucket_length: float = 0.5, num_tables: int = 4,
                   seed: int = 7) -> DataFrame:
    """Approximate alternative for very large corpora: pairs with cosine >=
    ``threshold`` found by random-projection LSH on unit vectors (may miss pairs)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    u = vectors.select(F.col(id_col).alias("id"), array_to_vector(V.unit(vec_col)).alias("u"))
    lsh = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed).fit(u)
    dist = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))   # |a-b| for unit vectors
    pairs = lsh.approxSimilarityJoin(u, u, dist, distCol="d")
    return (pairs.where(F.col("datasetA.id") < F.col("datasetB.id"))
            .select(F.col("datasetA.id").alias("id"), F.col("datasetB.id").alias("neighbor_id"),
                    F.round(1.0 - F.col("d") * F.col("d") / 2.0, ROUND).alias("similarity")))


__all__ = ["top_k", "similar_articles", "nearest", "class_vectors", "analogy", "cosmul", "word_algebra",
           "outlier", "category_distribution", "analogy_accuracy", "knn_graph", "similar_approx", "encode", "decode"]


def encode(words: DataFrame, vectors: DataFrame, word_col: str = "word", vec_col: str = "vec") -> DataFrame:
    """Vector of each word (inner join on the word; unknown words dropped)."""
    return words.join(vectors.select(word_col, vec_col), word_col, "inner")


def decode(queries: DataFrame, vectors: DataFrame, *, qid: str = "qid", qvec: str = "vec",
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Nearest stored vector of each query vector: (qid, id, similarity)."""
    return nearest(queries, vectors, 1, qid=qid, qvec=qvec, id_col=id_col, vec_col=vec_col).drop("rank")
