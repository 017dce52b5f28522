"""The most similar vectors of every vector (problem 4).

A hierarchical k-means tree is fitted on a bounded sample and shipped to the tasks; collections that need
more leaves than the sample can tell apart get a second level, fitted below each leaf by a task of its own.
Every distinct vector is stored in the leaf it descends to, and asks in the leaves that a best-bin-first
traversal visits: a priority queue holds the nodes seen so far by similarity of their centres, the best is
opened first. How many leaves are visited is calibrated: for queries on which the tree was not fitted the
true neighbours are found by brute force over the whole collection, and the visits are widened until enough
of them are met, up to all leaves, which is brute force leaf by leaf. Vectors are compared leaf by leaf in
matrix products; exact copies are one vector to the tree and are expanded after.

A vector is sent to each leaf it visits. The leaves are therefore served in rounds, each of which sends a
bounded number of vectors and frees its shuffle before the next: however many leaves are visited, disk
holds the vectors once, the best pairs so far, and one round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from evistrata.session import materialize, release

#: Bounds of what the driver ever holds: vectors to fit the upper tree on, queries to calibrate with, and leaves.
SAMPLE, CALIBRATION, LEAVES = 65_536, 4_096, 65_536
#: Vectors a leaf is meant to hold, children of an inner node at least, and sampled vectors a leaf is fitted on at least.
LEAF, BRANCH, FITTED = 6_000, 8, 32
#: Vectors of a leaf, and questions to a leaf, per task: a leaf that is larger is sent the questions several times.
BLOCK, ASKED = 49_152, 131_072
#: Vectors that a round sends, as a multiple of the collection.
COPIES = 2.0
#: Share of true neighbours that the visited leaves must hold, and the widest search that is calibrated first.
RECALL, WIDEST = 0.997, 64
#: Leaves that a traversal opens before it settles on the best of them.
LOOKED, WIDER = 16, 3
#: What a vector does in a leaf: it is stored there, asks there, or both.
HELD, ASKS, BOTH = 0, 1, 2
#: Similarities so near to the limit are computed again in double precision.
MARGIN = 1e-5


@dataclass
class Tree:
    """Centres of all nodes, the children of each, and the number of each leaf (-1 for inner nodes)."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: np.ndarray | None = None
    leaves: int = 0

    def visits(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` best leaves of each vector by best-bin-first traversal (-1 where there are fewer).

        The traversal opens WIDER times as many leaves, at least LOOKED of them; of those the ones whose
        centres are most similar are kept, best first.
        """
        most = min(most, self.leaves)
        if self.leaves == 1:
            return np.zeros((len(vectors), 1), np.int32)
        step = max(64, (1 << 24) // len(self.centres))
        if len(vectors) > step:
            return np.concatenate([self.visits(vectors[i : i + step], most) for i in range(0, len(vectors), step)])
        opened = min(self.leaves, max(LOOKED, WIDER * most))
        nodes = np.zeros((len(vectors), opened), np.int32)
        similar = vectors @ self.centres.T
        children = self.children
        for i, row in enumerate(-similar):
            near = row.tolist() if len(row) < 4_096 else row
            queue = [(near[c], c) for c in children[0]]
            heapq.heapify(queue)
            n = 0
            while n < opened:
                node = heapq.heappop(queue)[1]
                if children[node]:
                    for c in children[node]:
                        heapq.heappush(queue, (near[c], c))
                else:
                    nodes[i, n] = node
                    n += 1
        order = np.argsort(-np.take_along_axis(similar, nodes, 1), axis=1, kind="stable")[:, :most]
        return self.leaf[np.take_along_axis(nodes, order, 1)]


def _centres(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        for j in range(k):
            mine = points[own == j]
            if len(mine):
                total = mine.sum(0)
                centres[j] = total / (np.linalg.norm(total) or 1)
    return centres, (points @ centres.T).argmax(1)


def grow(sample: np.ndarray, rows: int, *, leaf: int = LEAF, branch: int | None = None, seed: int = 7) -> Tree:
    """Split the sample by k-means until each leaf stands for about ``leaf`` of ``rows`` vectors.

    Nodes have as many children as make two levels: each further level parts near vectors once more, so that a
    narrow tree of many levels needs several times the visits.
    """
    rng = np.random.default_rng(seed)
    branch = branch or max(BRANCH, int(np.ceil(min(rows / leaf, len(sample) / FITTED) ** 0.5)))
    share = rows / max(1, len(sample))
    centres, children = [np.zeros(sample.shape[1], np.float32)], [[]]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, members = todo.pop()
        k = min(branch, int(np.ceil(len(members) * share / leaf)), len(members) // FITTED)
        if k < 2:
            continue
        found, own = _centres(sample[members], k, rng)
        for j in range(k):
            children[node].append(len(centres))
            children.append([])
            centres.append(found[j])
            mine = members[own == j]
            if len(mine) < len(members):
                todo.append((children[node][-1], mine))
    return _numbered(np.stack(centres), children)


def _numbered(centres: np.ndarray, children: list[list[int]]) -> Tree:
    number = np.full(len(centres), -1, np.int32)
    ends = [i for i, c in enumerate(children) if not c]
    number[ends] = np.arange(len(ends))
    return Tree(centres.astype(np.float32), children, number, len(ends))


def deepen(tree: Tree, distinct: DataFrame, rows: int, dims: int, leaf: int) -> Tree:
    """The tree with each leaf split further, where its sample could not tell as many leaves apart as needed.

    A second, larger sample is drawn by hash and split below each leaf by a task; the driver gets centres
    only, of LEAVES leaves at most. Beyond about LEAVES * ``leaf`` vectors leaves grow with the collection.
    """
    wanted = min(LEAVES, int(np.ceil(rows / leaf)))
    if wanted <= tree.leaves * 2:
        return tree
    size = max(leaf, rows // wanted)
    share = min(1.0, 2 * FITTED * wanted / rows)
    shipped = distinct.sparkSession.sparkContext.broadcast(tree)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                home = shipped.value.visits(_matrix(part.column(1), dims), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), part.column(1)], ["leaf", "v"])

    def split(group: pa.Table) -> pa.Table:
        members = _matrix(group.sort_by("v")["v"].combine_chunks(), dims)
        k = min(int(np.ceil(len(members) / share / size)), len(members) // FITTED)
        found = _centres(members, k, np.random.default_rng(7))[0] if k > 1 else members[:0]
        return pa.table({"leaf": pa.array([group["leaf"][0].as_py()] * len(found), pa.int32()), "centre": pa.array([c.tobytes() for c in found.astype("<f4")], pa.binary())})

    drawn = distinct.where(_drawn("deeper", share)).select("id", "v").mapInArrow(descend, "leaf int, v binary")
    below = drawn.groupBy("leaf").applyInArrow(split, "leaf int, centre binary").toArrow().sort_by([("leaf", "ascending"), ("centre", "ascending")])
    if not below.num_rows:
        return tree
    nodes = {int(n): i for i, n in enumerate(tree.leaf) if n >= 0}
    found = _matrix(below["centre"].combine_chunks(), dims)
    children = [list(c) for c in tree.children] + [[] for _ in found]
    for i, n in enumerate(below["leaf"].to_pylist()):
        children[nodes[n]].append(len(tree.centres) + i)
    return _numbered(np.concatenate([tree.centres, found]), children)


def _drawn(purpose: str, share: float):
    """Whether a row is in a sample by its id's hash; the same rows on every run, other rows for another purpose."""
    return F.lit(share >= 1) | (F.xxhash64("id", F.lit(purpose)) < F.lit(int(-(2**63) + min(share, 1) * (2**64 - 1)) if share < 1 else 0))


def unit_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """``key, at, v``: the vectors of full length as bytes of float32, scaled to length one.

    Null vectors, those of other lengths, all zero, or with a null, NaN or infinite entry are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("at", pa.string()), ("v", pa.binary())])
        for batch in batches:
            lists = batch.column(2)
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            norms = np.sqrt(np.einsum("ij,ij->i", values, values))
            good = np.isfinite(norms) & (norms > 0)
            unit = np.ascontiguousarray(values[good] / norms[good, None], "<f4")
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([r.tobytes() for r in unit], pa.binary())], schema=schema)

    whole = F.col("vector").isNotNull() & (F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    rows = vectors.where(F.col("key").isNotNull() & whole).select("key", F.col("at").cast("string").alias("at"), F.col("vector").cast("array<float>").alias("vector"))
    return rows.mapInArrow(run, "key string, at string, v binary")


def _matrix(column: pa.Array, dims: int, kind: str = "<f4") -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float32, copy=False)


@dataclass
class Neighbours:
    """``edges``: key_a's distinct vector ``a``, its neighbour ``b``, similarity. ``members``: key and vector."""

    edges: DataFrame
    members: DataFrame
    visited: int
    recall: float
    leaves: int
    rounds: int


def nearest(
    vectors: DataFrame, *, dims: int = 128, k: int = 10, least: float | None = None, recall: float = RECALL, leaf: int = LEAF
) -> Neighbours:
    """For every distinct vector its ``k`` most similar others (of similarity ``least`` or more).

    ``vectors`` has ``key``, ``at`` and ``vector``. Of a repeated key the latest vector by ``at`` holds
    (ties: the greatest bytes). Vectors are named by a 64-bit hash of their bytes; equal vectors are one.
    """
    unit = unit_vectors(vectors, dims).withColumn("id", F.xxhash64("v"))
    # Copies of a vector collapse in each task before the shuffle, however many there are.
    members = materialize(unit.groupBy("key").agg(F.max(F.struct("at", "id")).alias("x")).select("key", F.col("x.id").alias("id")), free=True)
    distinct = unit.groupBy("id").agg(F.first("v").alias("v"))
    distinct = materialize(distinct.join(members.select("id").distinct(), "id", "left_semi"), free=True)
    spark = vectors.sparkSession
    rows = distinct.count()
    # Samples are drawn by hash, by every task from its own rows; their sizes are bounded whatever rows is.
    size = int(min(SAMPLE, max(2_000, 256 * rows / leaf)))
    # In the order of ids, so that the tree is the same however the rows are spread over tasks.
    drawn = distinct.where(_drawn("sample", size / max(1, rows))).select("id", "v").toArrow().sort_by("id") if rows else None
    sample = _matrix(drawn["v"].combine_chunks(), dims) if rows else np.zeros((0, dims), np.float32)
    tree = deepen(grow(sample, rows, leaf=leaf), distinct, rows, dims, leaf) if rows else grow(sample, rows, leaf=leaf)
    shipped = spark.sparkContext.broadcast(tree)

    # Queries to calibrate with are others than the tree was fitted on, where there are enough.
    held_out = distinct.where(~_drawn("sample", size / max(1, rows))) if rows > 2 * size else distinct
    asked = held_out.where(_drawn("calibration", CALIBRATION / max(1, rows - (size if rows > 2 * size else 0)))).select("id", "v").toArrow() if rows else None
    queries = _matrix(asked["v"].combine_chunks(), dims) if rows else sample
    visited, reached = _calibrate(distinct, queries, asked["id"].to_pylist() if rows else [], tree, shipped, dims, k, least, recall)
    # The sample tells about how many vectors, and questions, a leaf has; large leaves are dealt to several tasks.
    seen = tree.visits(sample, visited) if len(sample) else np.zeros((0, 1), np.int32)
    times = rows / max(1, len(sample))
    dealt = lambda leaves, most: np.maximum(1, np.ceil(np.bincount(leaves[leaves >= 0], minlength=tree.leaves) * times / most)).astype(int)
    shares = spark.sparkContext.broadcast((dealt(seen[:, 0], BLOCK), dealt(seen.ravel(), ASKED)))

    # Blocks are numbered leaf by leaf; a round serves a range of them.
    blocks, parts = shares.value
    asking, stored = (np.bincount(x[x >= 0], minlength=tree.leaves) * times for x in (seen.ravel(), seen[:, 0]))
    sent = np.cumsum(np.repeat(asking + stored * (parts - 1) / blocks, blocks))
    rounds = max(1, int(np.ceil(sent[-1] / (COPIES * max(1, rows)))))
    ends = [0, *np.searchsorted(sent, sent[-1] * np.arange(1, rounds) / rounds).tolist(), int(blocks.sum())]
    of_block = np.repeat(np.arange(tree.leaves), blocks)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                some = batch.slice(start, 2_048)
                leaves = shipped.value.visits(_matrix(some.column(1), dims), visited)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]), pa.array(leaves.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], ["id", "v", "leaves"])

    def placed(low: int, high: int) -> DataFrame:
        """The vectors stored and asking in the blocks from ``low`` to before ``high``."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, parts = shares.value
            first = np.cumsum(blocks) - blocks
            schema = pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("role", pa.int8()), ("id", pa.int64()), ("v", pa.binary())])

            def rows_of(row, leaf, block, part, role, some) -> pa.RecordBatch:
                now = (first[leaf] + block.astype(np.int64) >= low) & (first[leaf] + block.astype(np.int64) < high)
                columns = [pa.array(x[now].astype(np.int32)) for x in (leaf, block, part)]
                taken = pa.array(row[now])
                return pa.RecordBatch.from_arrays([*columns, pa.array(role[now].astype(np.int8)), some.column(0).take(taken), some.column(1).take(taken)], schema=schema)

            def repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.repeat(np.arange(len(counts)), counts)
                return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)

            for batch in batches:
                for start in range(0, batch.num_rows, 2_048):
                    some = batch.slice(start, 2_048)
                    leaves = some.column(2).flatten().to_numpy().reshape(some.num_rows, -1)
                    spread = some.column(0).to_numpy().view(np.uint64) >> np.uint64(7)
                    # A vector is stored in one block of its leaf, for each part of the questions ...
                    home = leaves[:, 0]
                    own_block, own_part = spread % blocks[home].astype(np.uint64), spread % parts[home].astype(np.uint64)
                    at, to_part = repeated(parts[home])
                    yield rows_of(at, home[at], own_block[at], to_part, np.where(to_part == own_part[at], BOTH, HELD), some)
                    # ... and is in one part of the questions to a leaf, for each block; where it is stored it asks as it is.
                    row, col = np.nonzero(leaves >= 0)
                    to = leaves[row, col]
                    at, to_block = repeated(blocks[to])
                    other = (col[at] > 0) | (to_block != own_block[row[at]])
                    at, to_block = at[other], to_block[other]
                    yield rows_of(row[at], to[at], to_block, (spread[row] % parts[to].astype(np.uint64))[at], np.full(len(at), ASKS), some)

        first_leaf, last_leaf = int(of_block[low]), int(of_block[high - 1])
        there = kept if rounds == 1 else kept.where(F.exists("leaves", lambda x: x.between(first_leaf, last_leaf)))
        return there.mapInArrow(place, "leaf int, block int, part int, role byte, id long, v binary")

    def compare(group: pa.Table) -> pa.Table:
        role = group["role"].combine_chunks()
        held, put = group.filter(pc.not_equal(role, ASKS)), group.filter(pc.not_equal(role, HELD))
        ids, v = held["id"].to_numpy(), _matrix(held["v"].combine_chunks(), dims)
        asked = put["id"].to_numpy()
        out, back = [], _none()
        step = max(64, min(1_024, (1 << 25) // max(1, len(ids))))
        for start in range(0, len(asked) if len(ids) else 0, step):
            mine = asked[start : start + step]
            q = _matrix(put["v"].slice(start, len(mine)).combine_chunks(), dims)
            met = _met(q, v, mine, ids, k, least)
            out.append(_top(*met[0], k))
            # What is found by asking is found for the vector that is held, too: its best are kept as well.
            back = _top(*(np.concatenate(x) for x in zip(back, met[1])), k)
        a, b, s = (np.concatenate(x) for x in zip(back, *out))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    kept = materialize(distinct.mapInArrow(descend, "id long, v binary, leaves array<int>"), free=True)
    release(distinct)
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    edges = None
    for low, high in zip(ends, ends[1:]):
        if low == high:
            continue
        met = placed(low, high).groupBy("leaf", "block", "part").applyInArrow(compare, "a long, b long, similarity double")
        # A pair is lost for an end only if neither asked where the other is. A vector has few rows, so those of
        # each are brought together once a round, and both its repeated pairs and its best are found there.
        met = (met.unionByName(edges) if edges else met).repartition("a").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        best = materialize(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), free=True)
        if edges:
            release(edges)
        edges = best
    release(kept)
    return Neighbours(edges, members, visited, reached, tree.leaves, rounds)


def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)


def _met(q, v, mine, ids, k: int, least: float | None):
    """Pairs of questions and held vectors as (a, b, similarity), by question and by held vector; those that
    cannot be among the best ``k`` of their first are left out."""
    similar = q @ v.T
    if least is not None:
        row, col = np.nonzero(similar >= least - MARGIN)
        keep = mine[row] != ids[col]
        row, col = row[keep], col[keep]
        s = similar[row, col].astype(np.float64)
        near = np.flatnonzero(np.abs(s - least) <= MARGIN)
        s[near] = np.einsum("ij,ij->i", q[row[near]].astype(np.float64), v[col[near]].astype(np.float64))
        row, col, s = row[s >= least], col[s >= least], s[s >= least]
        return (mine[row], ids[col], s), (ids[col], mine[row], s)
    n, m = min(k + 1, similar.shape[1]), min(k + 1, similar.shape[0])
    best = np.argpartition(-similar, n - 1, axis=1)[:, :n]
    row, col = np.repeat(np.arange(len(mine)), n), best.ravel()
    keep = mine[row] != ids[col]
    row, col = row[keep], col[keep]
    best = np.argpartition(-similar, m - 1, axis=0)[:m]
    row_b, col_b = best.ravel(), np.tile(np.arange(len(ids)), m)
    keep = mine[row_b] != ids[col_b]
    row_b, col_b = row_b[keep], col_b[keep]
    return (mine[row], ids[col], similar[row, col].astype(np.float64)), (ids[col_b], mine[row_b], similar[row_b, col_b].astype(np.float64))


def _top(a, b, s, k: int):
    """The ``k`` best of each first; of equally similar ones those of least id."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[keep], b[keep], s[keep]


def _calibrate(distinct, queries, query_ids, tree, shipped, dims, k, least, target) -> tuple[int, float]:
    """Leaves to visit, and the share of true neighbours met by then, from brute force for the queries.

    The target must be met even less one standard error, for which the neighbours of a query count as one
    observation each. Where WIDEST leaves do not reach it, more are tried, up to all, which miss nothing.
    Where the queries have no true neighbours nothing can be measured, and all leaves are visited.
    """
    if not len(queries) or tree.leaves == 1:
        return tree.leaves, 1.0
    opened = lambda width: min(tree.leaves, max(LOOKED, WIDER * width))
    most, settled = min(WIDEST, tree.leaves), False
    while True:
        places = _places(distinct, queries, query_ids, tree, shipped, dims, k, least, most)
        total = sum(places.values())
        met = total - places.get(most, 0)
        if not total:
            return tree.leaves, 1.0
        enough = total * min(1.0, target + (target * (1 - target) / total) ** 0.5)
        if met < enough:
            if most == tree.leaves:
                raise RuntimeError("true neighbours are missed although all leaves are visited")
            most = min(tree.leaves, most + (max(1, most // 4) if settled else most))
            continue
        if settled:
            return most, met / total
        width, met = 1, places.get(0, 0)
        while met < enough:
            met += places.get(width, 0)
            width += 1
        if opened(width) == opened(most):
            return width, met / total
        # A narrower search also opens fewer leaves to choose from, so it is measured by itself.
        most, settled = width, True


def _places(distinct, queries, query_ids, tree, shipped, dims, k, least, most) -> dict[int, int]:
    """How many true neighbours of the queries are met in the first, second, ... of ``most`` leaves."""
    spark = distinct.sparkSession
    asked = spark.sparkContext.broadcast((queries, np.array(query_ids), tree.visits(queries, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qids, order = asked.value
        tree = shipped.value
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            a, b, s = _pairs(q, qids, ids, v, k, least)
            if not len(b):
                continue
            # The pair is met if either one asks in the leaf that holds the other.
            near, where = np.unique(b, return_inverse=True)
            back = tree.visits(v[near], most)
            place = np.minimum(_place(order[a], back[where, 0], most), _place(back[where], order[a][:, 0], most))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s.astype(np.float64)), pa.array(place)], ["q", "s", "place"])

    near = distinct.mapInArrow(run, "q long, s double, place int")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "place"))).where(F.col("r") <= k)
    return {r["place"]: r["n"] for r in best.groupBy("place").agg(F.count("*").alias("n")).collect()}


def _place(order: np.ndarray, home: np.ndarray, most: int) -> np.ndarray:
    hit = order == home[:, None]
    return np.where(hit.any(1), hit.argmax(1), most).astype(np.int32)


def _pairs(q, qids, ids, v, k, least):
    similar = q @ v.T
    similar[qids[:, None] == ids[None, :]] = -2
    if least is not None:
        row, col = np.nonzero(similar >= least)
    else:
        n = min(k, similar.shape[1])
        col = np.argpartition(-similar, n - 1, axis=1)[:, :n].ravel()
        row = np.repeat(np.arange(len(q)), n)
        keep = similar[row, col] > -2
        row, col = row[keep], col[keep]
    return row, col, similar[row, col]


def similar_keys(found: Neighbours, *, k: int = 10) -> DataFrame:
    """``key, other, similarity, rank``: the ``k`` most similar others of every key, copies included.

    Copies of a key's own vector come first, then the keys of the neighbouring vectors; of equally
    similar keys the lesser comes first. Of a vector with any number of copies only the first k + 1 keys
    can be among the best, so only those are gathered; all copies still ask.
    """
    first = Window.partitionBy("id").orderBy("key")
    some = (
        found.members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        .groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    )
    edges = found.edges.select("a", "b", "similarity").union(
        some.where(F.size("keys") > 1).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    )
    others = (
        edges.join(some, edges["b"] == some["id"]).select("a", "similarity", F.explode("keys").alias("other"))
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "other"))).where(F.col("r") <= k + 1)
        .groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "other", "similarity"))).alias("list"))
    )
    own = found.members.join(others, found.members["id"] == others["a"])
    list_ = F.slice(F.filter("list", lambda x: x["other"] != F.col("key")), 1, k)
    return own.select("key", F.posexplode(list_).alias("rank", "x")).select("key", "x.other", "x.similarity", (F.col("rank") + 1).alias("rank"))


def close_pairs(found: Neighbours, *, k: int = 10) -> DataFrame:
    """``key_a < key_b``: pairs of which one is among the ``k`` most similar of the other."""
    near = similar_keys(found, k=k)
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def evidence_vectors(spans: DataFrame, risks: DataFrame) -> DataFrame:
    """The vectors of evidence spans and of risk factors as one collection."""
    a = spans.select(F.col("chunk_id").alias("key"), F.col("encoded_at").cast("string").alias("at"), F.col("embedding").alias("vector"))
    b = risks.select(F.col("risk_id").alias("key"), F.lit("").alias("at"), F.col("embedding").alias("vector"))
    return a.unionByName(b)
