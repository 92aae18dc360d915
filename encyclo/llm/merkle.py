"""Merkle manifest of a dataset: hash trees in van Emde Boas layout, proofs and their checks.

Rows become leaves, the leaves of a group (a source) in order make a tree in
which every three consecutive nodes have their digest as parent (a shorter
last run too, even of one node) until one node is left, and the roots of the
groups make a last tree in the same way.

A tree is stored as blocks of six levels of parents over 729 leaves.  A block
is one row: its nodes lie in van Emde Boas order, the top half of its levels
first, then the subtrees below, each cut in halves again (``address``).  The
same address arithmetic builds the block level by level and fetches siblings,
so a walk from a leaf to the root touches few stretches of memory at every
size of cache.  The roots of a tree's blocks are the leaves of its next tier,
stored in blocks again, until a tier has one block.

How it scales: rows are sorted once by (group, order), digests instead of
texts; their positions come from counters of each sorted part and one offset a
part.  A second shuffle deals them out by (group, block), so that a group with
any share of the rows is spread over its blocks, and a task holds a block at a
time.  Upper tiers have a 729th of the rows.  Proofs go down the tiers as one
path a block; they meet the rows inside the block and are hashed there.

Defined cases: null groups make one group, before all others; rows of equal
order are taken in the order of their leaves, null order values first.  An
empty table has an empty manifest and no proofs.  Other columns are neither
read nor returned; the kept ones may have any name.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_types, release, slices, stage

FAN = 3
HEIGHT = 6              # levels of parents in a stored block
LEAVES = FAN ** HEIGHT  # and its leaves
AT_ONCE = 32            # blocks in an Arrow batch

PATH = "array<struct<left:string,right:string>>"  # siblings before and after, from the leaf's level upwards


def n_nodes(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of nodes ``index`` of one ``depth`` in a tree of ``levels`` laid out by van Emde Boas:
    the upper half of the levels, then the subtrees under it from left to right, all cut likewise."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    below = FAN ** (depth - top)
    return (n_nodes(top) + index // below * n_nodes(levels - top)
            + address(depth - top, index % below, levels - top))


def digest_of(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*[c.cast("binary") for c in inputs]), 256)


def field(col: Column) -> Column:
    """A value with its length in bytes: ``3:abc``; ``-`` for null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


class Tree:
    """One block: ``nodes`` holds the digests of ``n`` leaves and all their parents in van Emde Boas order."""

    def __init__(self, n: int, whole: bool, nodes: np.ndarray | None = None):
        # a block of a larger tree has all its levels; a tree in one block ends at its only node
        height = HEIGHT
        if not whole:
            height = 0
            while FAN ** height < n:
                height += 1
        self.levels = height + 1
        self.counts = [-(-n // FAN ** (height - d)) for d in range(height + 1)]
        self.nodes = np.zeros((n_nodes(self.levels), 32), np.uint8) if nodes is None else nodes.reshape(-1, 32)

    def at(self, depth: int) -> np.ndarray:
        return address(depth, np.arange(self.counts[depth]), self.levels)

    def hexes(self, depth: int) -> bytes:
        """Hex digests of one level, 64 characters each."""
        return hexlify(self.nodes[self.at(depth)].tobytes())

    @classmethod
    def build(cls, leaves: np.ndarray, whole: bool) -> Tree:
        tree = cls(len(leaves), whole)
        tree.nodes[tree.at(tree.levels - 1)] = leaves
        for depth in range(tree.levels - 1, 0, -1):
            below = tree.hexes(depth)
            made = b"".join(hashlib.sha256(below[a:a + 64 * FAN]).digest() for a in range(0, len(below), 64 * FAN))
            tree.nodes[tree.at(depth - 1)] = np.frombuffer(made, np.uint8).reshape(-1, 32)
        return tree

    def siblings(self) -> list[list[tuple[bytes, bytes]]]:
        """For every depth from the leaves' to just under the root: what stands before and
        after each node in its run."""
        out = []
        for depth in range(self.levels - 1, 0, -1):
            row, n = self.hexes(depth), self.counts[depth]
            level = []
            for i in range(n):
                first = i - i % FAN
                level.append((row[64 * first:64 * i], row[64 * (i + 1):64 * min(first + FAN, n)]))
            out.append(level)
        return out


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows (``_g``, ...) with ``_pos``, their 0-based place in their group by ``order``; stored.

    Rows are range-partitioned by (group, order) and counted where they lie.
    Only a part's first group can have begun in an earlier part: one offset a part mends that.
    """
    cols = df.columns
    keys = [F.col("_g").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    out = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                        T.StructField("_i", T.LongType()), T.StructField("_row", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, row, run, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(b.schema.get_field_index("_g"))
            new = np.ones(n, dtype=bool)
            if n > 1:
                a, z = g.slice(0, n - 1), g.slice(1)
                new[1:] = pc.or_(pc.xor(a.is_null(), z.is_null()), pc.fill_null(pc.not_equal(a, z), False)) \
                    .to_numpy(zero_copy_only=False)
            new[0] = row == 0 or last != g[0].as_py()
            place = np.arange(row, row + n)
            starts = np.where(new, place, -1)
            if not new[0]:
                starts[0] = run
            starts = np.maximum.accumulate(starts)
            run, last, row = int(starts[-1]), g[n - 1].as_py(), row + n
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in cols]
                + [pa.array(np.full(n, part), pa.int32()), pa.array(place - starts), pa.array(place)], names=out.names)

    placed = stage(df.withColumn("_tie", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .drop("_tie").mapInArrow(count, out), "merkle-order")
    # one row a part on the driver: its first and last group, and how far the last group has come
    ends = placed.groupBy("_part").agg(F.min_by(F.struct("_g"), "_row").alias("a"), F.max_by(F.struct("_g"), "_row").alias("z"),
                                       F.max_by("_i", "_row").alias("i"), F.max("_row").alias("n")).orderBy("_part").collect()
    offsets, group, came = [], None, 0
    for e in ends:
        before = came if group is not None and group == e.a else 0
        if before:
            offsets.append((e._part, before))
        came = e.i + 1 + (before if e.i == e.n else 0)
        group = e.z
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _off long"))
    in_first = F.when(F.col("_i") == F.col("_row"), F.coalesce("_off", F.lit(0))).otherwise(F.lit(0))
    return placed.join(shift, F.col("_part") == F.col("_p"), "left").select(*cols, (F.col("_i") + in_first).alias("_pos"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows (``_g``, ``_pos``, ``_digest`` binary, ``_keep`` any) -> one row a block:
    (_g, _block, n, nodes, root, keeps)."""
    keep = nodes.schema["_keep"].dataType
    out = T.StructType([nodes.schema["_g"], T.StructField("_block", T.LongType()), T.StructField("n", T.IntegerType()),
                        T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType()),
                        T.StructField("keeps", T.ArrayType(keep))])
    types = arrow_types(out)

    def column(b: pa.RecordBatch, name: str) -> pa.Array:
        return b.column(b.schema.get_field_index(name))

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block after the other: a block starts at a position that its size divides."""
        rest: list[pa.RecordBatch] = []
        for b in slices(batches):
            cuts = np.flatnonzero(column(b, "_pos").to_numpy() % LEAVES == 0).tolist()
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if a in cuts and rest:
                    yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                    rest = []
                if z > a:
                    rest.append(b.slice(a, z - a))
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.concat_arrays([m[0] for m in made])]
            cols += [pa.array([m[i] for m in made], types[out.names[i]]) for i in range(1, 5)]
            off = np.concatenate(([0], np.cumsum([len(m[5]) for m in made])))
            cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.concat_arrays([m[5] for m in made])))
            return pa.RecordBatch.from_arrays(cols, names=out.names)

        for b in whole_blocks(batches):
            n, block = b.num_rows, int(column(b, "_pos")[0].as_py()) // LEAVES
            leaves = np.frombuffer(b"".join(column(b, "_digest").to_pylist()), np.uint8).reshape(n, 32)
            tree = Tree.build(leaves, whole=block > 0 or n == LEAVES)
            made.append([column(b, "_g").slice(0, 1), block, n, tree.nodes.tobytes(), tree.nodes[0].tobytes(), column(b, "_keep")])
            if len(made) == AT_ONCE:
                yield batch()
                made.clear()
        if made:
            yield batch()
        release()

    return (nodes.withColumn("_block", F.floor(F.col("_pos") / LEAVES))
            .repartition("_g", "_block").sortWithinPartitions(F.col("_g").asc_nulls_first(), "_block", "_pos")
            .drop("_block").mapInArrow(run, out))


# whether a block is a whole tree; one of 729 leaves may be either and goes on to the next tier as a lone leaf
_ALONE = f"_block = 0 and n < {LEAVES}"


def build(nodes: DataFrame) -> list[DataFrame]:
    """Stored tiers of the trees of rows (``_g``, ``_pos``, ``_digest``, ``_keep``), lowest first."""
    tiers = []
    while True:
        tiers.append(stage(_blocks(nodes), f"merkle-tier{len(tiers)}"))
        nodes = tiers[-1].where(f"not ({_ALONE})").select("_g", F.col("_block").alias("_pos"), F.col("root").alias("_digest"),
                                                F.lit(None).cast("boolean").alias("_keep"))
        if nodes.isEmpty():
            return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(_g, root) of all groups."""
    found = [t.where(_ALONE).select("_g", "root") for t in tiers]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest tier with ``_path``, the siblings from the block's root to the very root,
    and the columns of ``above`` (_g, _path, more), which continues each group's tree."""
    more = [c for c in above.columns if c not in ("_g", "_path")]
    above = above.withColumnRenamed("_g", "_ag")
    upper = None
    for t in reversed(range(len(tiers))):
        tier = tiers[t].drop("keeps") if t else tiers[t]
        own = tier.where(_ALONE).join(above, F.col("_g").eqNullSafe(F.col("_ag"))).drop("_ag")
        if upper is not None:
            low = tier.where(f"not ({_ALONE})")
            up = upper.select(F.col("_g").alias("_ug"), F.col("_block").alias("_ub"), "_path", *more)
            own = own.unionByName(low.join(up, F.col("_g").eqNullSafe(F.col("_ug")) & (F.col("_block") == F.col("_ub")))
                                  .drop("_ug", "_ub"))
        if not t:
            return own
        upper = _paths(own, more)


def _paths(blocks: DataFrame, more: list[str]) -> DataFrame:
    """(_g, _block, _path, more): for every leaf of the blocks, which is a block of the tier below."""
    out = T.StructType([blocks.schema["_g"], T.StructField("_block", T.LongType()),
                        blocks.schema["_path"], *[blocks.schema[c] for c in more]])
    types = arrow_types(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(i).slice(r, 1) for i, c in enumerate(b.schema.names)}
                block, n = one["_block"][0].as_py(), one["n"][0].as_py()
                tree = Tree(n, block > 0 or n == LEAVES, np.frombuffer(one["nodes"][0].as_py(), np.uint8))
                levels, up = tree.siblings(), one["_path"][0].as_py()
                paths = [[{"left": lv[i // FAN ** d][0].decode(), "right": lv[i // FAN ** d][1].decode()}
                          for d, lv in enumerate(levels)] + up for i in range(n)]
                repeat = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [one["_g"].take(repeat), pa.array(np.arange(n) + block * LEAVES), pa.array(paths, types["_path"]),
                     *[one[c].take(repeat) for c in more]], names=out.names)

    return blocks.select("_g", "_block", "n", "nodes", "_path", *more).mapInArrow(run, out)


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, keep: list[str],
             other: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored blocks of the groups' trees and of the tree over the groups' roots.

    ``leaf`` and ``other`` (a second digest carried beside it, null if equal) are
    hex digests of a row; ``keep`` travels with the leaves.
    """
    other = F.lit(None).cast("string") if other is None else other
    leaves = rows.select(group.alias("_g"), order.alias("_o"), F.unhex(leaf).alias("_digest"),
                         F.struct(*[F.col(c) for c in keep]).alias("_kept"), F.unhex(other).alias("_other"))
    placed = numbered(leaves, ["_o", "_digest"])
    tiers = build(placed.select("_g", "_pos", "_digest", F.struct("_kept", "_other").alias("_keep")))
    tops = roots(tiers).select(F.lit(0).alias("_g"), F.col("_g").alias("_o"), F.col("root").alias("_digest"))
    placed = numbered(tops, ["_o", "_digest"])
    return tiers, build(placed.select("_g", "_pos", "_digest", F.struct("_o").alias("_keep")))


def check(tiers: list[DataFrame], top: list[DataFrame]) -> DataFrame:
    """Every leaf's proof, and the root recomputed with its other digest (its own where there is none).

    Returns the kept columns, leaf, subroot, root, proof_sha256 (of all siblings from the
    leaf's level to the root, left to right), folded_root and verified; a kept column
    named like one of these gives way.
    """
    root = roots(top).select("_g", F.array().cast(PATH).alias("_path"), F.lower(F.hex("root")).alias("_root"))
    groups = _group_paths(_descend(top, root))
    blocks = _descend(tiers, groups)
    kept_type = blocks.schema["keeps"].dataType.elementType["_kept"].dataType
    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = T.StructType([T.StructField("_kept", kept_type), *[T.StructField(c, T.StringType()) for c in text],
                        T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                n, block = col["n"][r].as_py(), col["_block"][r].as_py()
                tree = Tree(n, block > 0 or n == LEAVES, np.frombuffer(col["nodes"][r].as_py(), np.uint8))
                keeps = col["keeps"].slice(r, 1).flatten()
                other = [x and hexlify(x) for x in keeps.field("_other").to_pylist()]
                own = tree.hexes(tree.levels - 1)
                levels = tree.siblings()
                up = [(p["left"].encode(), p["right"].encode()) for p in col["_path"][r].as_py()]
                above = b"".join(a + z for a, z in up)
                leaf, proof, folded = [], [], []
                for i in range(n):
                    leaf.append(own[64 * i:64 * i + 64])
                    now, seen, j = other[i] or leaf[i], sha(), i
                    for level in levels:
                        a, z = level[j]
                        seen.update(a)
                        seen.update(z)
                        now = sha(a + now + z).hexdigest().encode()
                        j //= FAN
                    seen.update(above)
                    for a, z in up:
                        now = sha(a + now + z).hexdigest().encode()
                    proof.append(seen.hexdigest())
                    folded.append(now.decode())
                root = col["_root"][r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [keeps.field("_kept"), pa.array([x.decode() for x in leaf]), pa.array([col["_subroot"][r].as_py()] * n, pa.string()),
                     pa.array([root] * n, pa.string()), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
                    names=out.names)
        release()

    done = blocks.select("_block", "n", "nodes", "keeps", "_path", "_subroot", "_root").mapInArrow(run, out)
    return done.select(*[F.col("_kept")[c].alias(c) for c in kept_type.names if c not in out.names], *out.names[1:])


def _group_paths(blocks: DataFrame) -> DataFrame:
    """(_g, _path, _subroot, _root) of the groups, the leaves of the last tree."""
    out = T.StructType([T.StructField("_g", blocks.schema["keeps"].dataType.elementType["_o"].dataType),
                        blocks.schema["_path"], T.StructField("_subroot", T.StringType()), T.StructField("_root", T.StringType())])
    types = arrow_types(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                n, block = col["n"][r].as_py(), col["_block"][r].as_py()
                tree = Tree(n, block > 0 or n == LEAVES, np.frombuffer(col["nodes"][r].as_py(), np.uint8))
                own, levels, up = tree.hexes(tree.levels - 1).decode(), tree.siblings(), col["_path"][r].as_py()
                paths = [[{"left": lv[i // FAN ** d][0].decode(), "right": lv[i // FAN ** d][1].decode()}
                          for d, lv in enumerate(levels)] + up for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [col["keeps"].slice(r, 1).flatten().field("_o"), pa.array(paths, types["_path"]),
                     pa.array([own[64 * i:64 * i + 64] for i in range(n)]), pa.array([col["_root"][r].as_py()] * n, pa.string())],
                    names=out.names)

    return blocks.select("_block", "n", "nodes", "keeps", "_path", "_root").mapInArrow(run, out)
