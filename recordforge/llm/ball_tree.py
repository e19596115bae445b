"""Exact top-k inner-product search with ball trees.

Vectors are dealt to cells of like vectors: a bounded sample is halved again
and again along the line between two distant members, and every vector goes down
these halvings. A cell of many vectors is cut into shards of at most about
`SHARD` by a hash. One task builds the ball tree of a shard (each ball has a
centre and a radius; it is halved like the sample) and writes it, so each tree is
built once. A cell's ball covers those of its shards; at most `CELLS` of them go
to all tasks.

Branch and bound. A query first meets the shards of one cell, the one whose
centre has the largest product with it. The kth score there is its floor; then
it goes, with the floor, to every other cell whose upper bound q.c + |q| r
reaches it, and to no other. In a tree, nodes are visited in the order of their
upper bound and left out below the query's current kth score. A shard's queries
are dealt in blocks of about `QUERIES`. Each (shard, block) pair gives at most k
rows for each query, and those of all shards are ranked together.

Defined cases: vectors that are null or empty, or hold a null or non-finite
component, and rows without an id take no part; a query without candidates has no
rows; fewer than k candidates are all returned; ties go to the smaller id; rows
of a query's own id are no candidates of it; repeated rows are separate
candidates but ask once, and different vectors of one id ask separately; only
vectors of equal length are compared; scores are exact below 2^53 and end at
2^62; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from recordforge.sources.tables import materialise

SHARD, QUERIES, LEAF = 8192, 1024, 64
#: Cells at the most, and sampled vectors for each.
CELLS, SAMPLED = 1024, 32


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place along the line between two distant rows, and the line."""
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    line = x[((x - a) ** 2).sum(1).argmax()] - a
    return x @ line, line


class Tree:
    """A ball tree over integer vectors; node i holds rows lo[i] to hi[i] of the permuted data."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        centre, radius, span, children = [], [], [], []

        def build(lo: int, hi: int) -> int:
            rows = x[order[lo:hi]]
            c = rows.mean(0)
            far = ((rows - c) ** 2).sum(1)
            me = len(centre)
            centre.append(c)
            radius.append(float(np.sqrt(far.max())) * (1 + 1e-9) + 1e-9)
            span.append((lo, hi))
            children.append(None)
            if hi - lo > leaf:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(halves(rows)[0], mid)]
                left = build(lo, lo + mid)
                children[me] = (left, build(lo + mid, hi))
            return me

        if len(x):
            build(0, len(x))
        self.centre, self.radius, self.span, self.children = np.array(centre), np.array(radius), span, children
        self.x, self.ids = x[order], ids[order]

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but `own`; those below `floor` may be left out."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        length = float(np.sqrt(q @ q))
        bound = self.centre @ q + length * self.radius + 1e-6
        heap = [(-bound[0], 0)]
        ids, scores, kth = np.zeros(0, np.int64), np.zeros(0), floor
        while heap and -heap[0][0] >= kth:
            _, i = heapq.heappop(heap)
            if self.children[i]:
                for c in self.children[i]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.span[i]
            s, v = self.x[lo:hi] @ q, self.ids[lo:hi]
            at = np.flatnonzero((s >= kth) & (v != own))
            if len(at):
                ids, scores = np.concatenate((ids, v[at])), np.concatenate((scores, s[at]))
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, float(scores.min()))
        return ids, scores


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); vectors that take no part are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))
    return df.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def split_sample(x: np.ndarray, cells: int) -> list:
    """Halvings of a sample as nodes (line, threshold, left, right) or cell numbers, the root first."""
    nodes: list = []
    ends = iter(range(cells))

    def go(rows: np.ndarray, parts: int) -> int:
        me = len(nodes)
        nodes.append(None)
        along, line = halves(rows) if parts > 1 and len(rows) > 1 else (None, None)
        if along is None or along.min() == along.max():
            nodes[me] = next(ends)
            return me
        at = float(np.median(along))
        if at == along.max():
            at = float(along[along < at].max())
        left = go(rows[along <= at], parts // 2)
        nodes[me] = (line, at, left, go(rows[along > at], parts - parts // 2))
        return me

    if len(x):
        go(x, cells)
    return nodes or [0]


def locate(nodes: list, x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
    while todo:
        i, rows = todo.pop()
        if isinstance(nodes[i], tuple):
            line, at, left, right = nodes[i]
            low = x[rows] @ line <= at
            todo += [(left, rows[low]), (right, rows[~low])]
        else:
            out[rows] = nodes[i]
    return out


def _cells(vectors: DataFrame, n: int) -> DataFrame:
    """Adds width and cell."""
    sized = vectors.withColumn("width", F.size("v"))
    cells = min(CELLS, -(-n // SHARD))
    splits: dict[int, list] = {}
    if cells > 1:
        share = int(1_000_003 * min(1.0, SAMPLED * cells / n))
        few = sized.filter(F.pmod(F.xxhash64("vec_id", F.lit("cell")), F.lit(1_000_003)) < share)

        def split(batches):
            held: dict[int, list] = {}
            for batch in batches:
                for v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.setdefault(w, []).append(v)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({w: split_sample(np.array(x), cells) for w, x in held.items()})])], names=["splits"])

        splits = pickle.loads(few.select("v", "width").repartition(1).mapInArrow(split, "splits binary").first()["splits"])

    def place(batches):
        for batch in batches:
            width = np.asarray(batch.column(2))
            cell = np.zeros(len(width), np.int32)
            for w in np.unique(width).tolist():
                if w in splits:
                    rows = np.flatnonzero(width == w)
                    cell[rows] = locate(splits[w], _matrix(batch.column(1).take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "width", "cell"])

    return sized.select("vec_id", "v", "width").mapInArrow(place, "vec_id long, v array<double>, width int, cell int")


def _trees(located: DataFrame) -> DataFrame:
    """(width, cell, part, centre, radius, tree): the ball tree of each shard."""

    def build(table: pa.Table) -> pa.Table:
        tree = Tree(_matrix(table.column("v").combine_chunks()), np.asarray(table.column("vec_id")))
        first = lambda c: table.column(c).slice(0, 1)
        return pa.table([first("width"), first("cell"), first("part"), pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())), pa.array([tree.radius[0]]), pa.array([pickle.dumps(vars(tree))])], names=["width", "cell", "part", "centre", "radius", "tree"])

    parts = located.groupBy("width", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    dealt = located.join(F.broadcast(parts), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    return dealt.groupBy("width", "cell", "part").applyInArrow(build, "width int, cell int, part int, centre array<double>, radius double, tree binary")


def _balls(trees: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By width: cells, centres and radii that cover their shards. At most `CELLS` for each width."""
    one = trees.groupBy("width", "cell").agg(F.min_by("centre", "part").alias("_c"))
    apart = trees.select("width", "cell", "centre", "radius").join(F.broadcast(one), ["width", "cell"])
    reach = F.sqrt(F.aggregate(F.zip_with("centre", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)) + F.col("radius")
    rows = sorted(apart.groupBy("width", "cell").agg(F.first("_c").alias("c"), F.max(reach).alias("r")).collect(), key=lambda r: (r["width"], r["cell"]))
    return {w: (np.array([r["cell"] for r in rows if r["width"] == w]), np.array([r["c"] for r in rows if r["width"] == w]), np.array([r["r"] for r in rows if r["width"] == w]) * (1 + 1e-9) + 1e-9) for w in {r["width"] for r in rows}}


def _send(asked: DataFrame, balls: dict, first: bool) -> DataFrame:
    """A query for its home cell, or for every other cell whose bound reaches its floor."""

    def run(batches):
        for batch in batches:
            width, floor = np.asarray(batch.column(3)), batch.column(4).to_numpy(zero_copy_only=False)
            rows, cells = [], []
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                cell, centre, radius = balls[w]
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    q = _matrix(batch.column(2).take(pa.array(part)))
                    near = q @ centre.T
                    home = near.argmax(1)
                    if first:
                        rows.append(part)
                        cells.append(cell[home])
                        continue
                    bound = near + np.sqrt((q * q).sum(1))[:, None] * radius + 1e-6 * (1 + np.abs(near))
                    bound[np.arange(len(part)), home] = -np.inf
                    i, j = np.nonzero((bound >= floor[part][:, None]) & (bound > -np.inf))
                    rows.append(part[i])
                    cells.append(cell[j])
            rows, cells = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(cells.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return asked.select("vec_id", "hash", "v", "width", "floor").mapInArrow(run, "vec_id long, hash long, v array<double>, width int, floor double, cell int")


def _search(sent: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(query_id, hash, vec_id, score): the k best of every shard of the cells that queries are sent to."""

    def run(table: pa.Table) -> pa.Table:
        held = table.column("tree").drop_null()
        asked = table.filter(pa.compute.is_null(table.column("tree")))
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(held) and len(asked):
            tree = Tree.__new__(Tree)
            vars(tree).update(pickle.loads(held[0].as_py()))
            ids, hashes, floors = (asked.column(c).to_numpy() for c in ("vec_id", "hash", "floor"))
            for own, name, floor, q in zip(ids.tolist(), hashes.tolist(), floors.tolist(), _matrix(asked.column("v").combine_chunks())):
                v, s = tree.search(q, own, k, floor)
                out[0].extend([own] * len(v))
                out[1].extend([name] * len(v))
                out[2].extend(v.tolist())
                out[3].extend(np.clip(s, -(2.0**62), 2.0**62).astype(np.int64).tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "hash", "vec_id", "score"])

    shards = trees.select("width", "cell", "part")
    pairs = sent.join(shards, ["width", "cell"])
    blocks = pairs.groupBy("width", "cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    queries = pairs.join(blocks, ["width", "cell", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "hash"), F.col("blocks")).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    held = trees.join(blocks, ["width", "cell", "part"]).select("width", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), null("long").alias("vec_id"), null("long").alias("hash"), null("array<double>").alias("v"), null("double").alias("floor"), "tree")
    both = queries.select("width", "cell", "part", "block", "vec_id", "hash", "v", "floor", null("binary").alias("tree")).unionByName(held)
    return both.groupBy("width", "cell", "part", "block").applyInArrow(run, "query_id long, hash long, vec_id long, score long")


def top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row with all other rows.

    `queries` is a condition on vec_id.
    """
    vectors = quantised(df, id_col, vector_col, scale)
    located = materialise(_cells(vectors, vectors.count()), "vectors")
    trees = materialise(_trees(located), "trees")
    balls = _balls(trees)
    asked = located.filter(queries).select("vec_id", F.xxhash64("v").alias("hash"), "v", "width").dropDuplicates(["vec_id", "hash"])
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    none = F.lit(float("-inf"))
    first = materialise(best(_search(_send(asked.withColumn("floor", none), balls, True), trees, k)), "near-home")
    if sum(len(cell) for cell, _, _ in balls.values()) == 1:
        found = first
    else:
        floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("hash").alias("_hash"), F.col("score").cast("double").alias("floor"))
        known = asked.join(floors, (F.col("vec_id") == F.col("_query")) & (F.col("hash") == F.col("_hash")), "left").withColumn("floor", F.coalesce("floor", none))
        found = best(first.drop("rank").unionByName(_search(_send(known, balls, False), trees, k)))
    return found.select("query_id", "rank", "vec_id", "score")
