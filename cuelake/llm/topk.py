"""Exact top-k inner products by dual-tree search over cover trees.

Queries and candidates are dealt to the same cells (nets of centres as the upper levels of a cover tree, fitted on a
bounded sample; every row is indexed). A cell, cut into blocks of bounded size, is a node with a centre and a covering
radius. Groups of queries and blocks of candidates are paired from the top: first each group with the few blocks
that promise most, which gives every query a k-th score; then with every block that may still beat the group's worst
k-th score. A block meets all queries that ask for it at once: its tree is built once, and only queries are copied. There
both sides are split on (cover trees over the block's vectors and over each group), and node pairs are pruned by
the same bound:  <q, y> <= <cq, cy> + |cq| ry + |cy| rq + rq ry.

Products are of whole numbers in floating point, which is exact below 2^24 or 2^53; larger ones are multiplied as integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import written

K = 5
#: Stand for a missing score (it can be negated) and a missing id.
NONE, NO_ID = -(1 << 62), np.iinfo(np.int64).max
#: Sampled rows and centres of the upper levels; rows of a leaf in a block's own tree; candidates multiplied at once.
SAMPLE, CENTRES, LEAF, STEP = 2000, 48, 256, 4096
#: Rows of a block: at least BLOCK, in large tables a share of all rows, and never over MOST, nor are the queries that it meets at once.
BLOCK, SHARE, MOST = 2048, 64, 65536
#: Blocks that each group of queries meets first.
FIRST = 4


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(256 x) of each component; vectors that are null, or hold null or non-finite
    components, are left out, as are rows without a vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def centres(rows: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first net: each next centre is the sampled row farthest from all before."""
    if not len(rows):
        return rows
    chosen = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def dealt(points: DataFrame, net: np.ndarray, kind: str) -> DataFrame:
    """vec_id, v and the cell (nearest centre), a salt that spreads equal rows, and the distance to the centre; ``kind``
    is the type of a component."""
    known = points.sparkSession.sparkContext.broadcast(net.astype(np.float64))

    def run(batches):
        net = known.value
        norm = (net**2).sum(1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = matrix(batch.column(1), net.shape[1]).astype(np.float64)
            square = norm - 2 * (x @ net.T)
            cell = square.argmin(1).astype(np.int64)
            distance = np.sqrt(((x - net[cell]) ** 2).sum(1))
            part = ((ids * 0x9E3779B1 >> 7) + np.arange(len(ids))) % (1 << 20)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell), pa.array(part.astype(np.int64)), pa.array(distance)], names=["vec_id", "v", "cell", "part", "far"]
            )

    return points.mapInArrow(run, f"vec_id long, v array<{kind}>, cell long, part long, far double")


def whole_type(least: int, most: int) -> str:
    """The narrowest type of whole numbers that holds both."""
    return next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= least and most < 1 << bits)


def few_of_equal(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows that may be among the K best of any query. Equal vectors have equal scores with it, so that the smallest K ids
    other than its own are enough: K rows of an id, and 2 K of a vector."""
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)[1] if v.shape[1] else np.zeros(len(v), np.int64)
    order = np.lexsort((ids, same))
    for columns, most in (((same, ids), K), ((same,), 2 * K)):
        new = np.r_[True, np.any([np.diff(c[order]) != 0 for c in columns], axis=0)] if len(order) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        order = order[np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)])) < most]
    return np.sort(order)


class Tree:
    """A block's own cover tree, as nested nodes: rows, centre, covering radius, children."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.rows, self.kids = rows, []
        self.centre = x[rows].mean(0)
        away = np.sqrt(((x[rows] - self.centre) ** 2).sum(1))
        self.radius = float(away.max(initial=0.0))
        self.norm = float(np.sqrt((self.centre**2).sum()))
        if len(rows) > LEAF and self.radius > 0:
            net = centres(x[rows], 4)
            near = ((net**2).sum(1) - 2 * (x[rows] @ net.T)).argmin(1)
            parts = [rows[near == k] for k in range(len(net))]
            if max(map(len, parts)) < len(rows):
                self.kids = [Tree(x, p) for p in parts if len(p)]

    def bound(self, other: Tree) -> float:
        """No inner product between the nodes is larger."""
        return float(self.centre @ other.centre) + self.norm * other.radius + other.norm * self.radius + self.radius * other.radius


class Best:
    """The k best (score, vec_id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, own: np.ndarray, worst: np.ndarray):
        n = len(own)
        self.score = np.full((n, K), NONE, np.int64)
        self.id = np.full((n, K), NO_ID, np.int64)
        self.own, self.floor = own, worst  # k-th scores known from other blocks

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, asking: np.ndarray) -> None:
        """Take in the products of ``rows`` with candidates, of which the places ``asking`` are queries too. Only those that
        reach a row's k-th score are sorted."""
        own, place = np.nonzero(self.own[rows][:, None] == ids[asking][None, :])
        scores[own, asking[place]] = NONE
        least = self.kth(rows).astype(scores.dtype)
        reached = scores >= least[:, None]
        if scores.shape[1] > K and np.count_nonzero(reached) > 4 * K * len(rows):
            reached = scores >= np.maximum(least, np.partition(scores, -K, axis=1)[:, -K])[:, None]
        row, at = np.divmod(np.flatnonzero(reached), scores.shape[1])
        found = scores[row, at]
        row, at, found = (x[found > NONE] for x in (row, at, found))
        if not len(row):
            return
        old_row, old = np.nonzero(self.id[rows] != NO_ID)
        row = np.r_[old_row, row]
        score = np.r_[self.score[rows[old_row], old], found.astype(np.int64)]
        name = np.r_[self.id[rows[old_row], old], ids[at]]
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        keep = rank < K
        self.score[rows[row[keep]], rank[keep]] = score[keep]
        self.id[rows[row[keep]], rank[keep]] = name[keep]


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, group: np.ndarray | None = None) -> Best:
    """Dual-tree search of groups of queries (one group by default) in one block of candidates. Node pairs go down together, the
    most promising first; the leaves that a query leaf can't rule out are multiplied with it, some at once."""
    best = Best(own, floor)
    x, y = queries.astype(np.float64), data.astype(np.float64)
    # no part of a sum of products is larger than the product of the norms
    most = (np.sqrt((x**2).sum(1)).max(initial=0) + 1) * (np.sqrt((y**2).sum(1)).max(initial=0) + 1)
    exact = (x.astype(np.float32), y.astype(np.float32)) if most < 2**24 else (x, y) if most < 2**53 else (queries.astype(np.int64), data.astype(np.int64))
    asks = np.isin(ids, own)
    top = Tree(y, np.arange(len(data)))
    group = np.zeros(len(own), np.int64) if group is None else group
    stack = [Tree(x, np.flatnonzero(group == g)) for g in np.unique(group)]
    while stack:
        a = stack.pop()
        if a.kids:
            stack += a.kids
            continue
        # down the candidates' tree, a level at a time; the best node's leaf gives a first k-th score
        nodes = _may_win(a, [top], best)
        while any(b.kids for b in nodes):
            nodes = [c for b in nodes for c in (b.kids or [b])]
            nodes = _may_win(a, nodes, best)
        nodes.sort(key=a.bound, reverse=True)
        for part in _together(nodes):
            part = _may_win(a, part, best)
            if part:
                rows = np.concatenate([b.rows for b in part])
                for k in range(0, len(rows), STEP):
                    at = rows[k : k + STEP]
                    best.add(a.rows, exact[0][a.rows] @ exact[1][at].T, ids[at], np.flatnonzero(asks[at]))
    return best


def _together(nodes: list[Tree]) -> list[list[Tree]]:
    """The first node alone, the others in lists of about STEP rows."""
    size = np.cumsum([0, *(len(b.rows) for b in nodes[1:])])
    cuts = [1 + int(k) for k in np.searchsorted(size, np.arange(STEP, size[-1], STEP))]
    edges = sorted({0, min(1, len(nodes)), *cuts, len(nodes)})
    return [nodes[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def _may_win(a: Tree, nodes: list[Tree], best: Best) -> list[Tree]:
    least = float(best.kth(a.rows).min()) if len(a.rows) else 0.0
    return [b for b in nodes if a.bound(b) >= least - 1e-6 * (1 + a.norm * b.norm)]


FOUND = "query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, queries: DataFrame, placed: DataFrame, tasks: int) -> DataFrame:
    """Search of all pairs (group, slice, block) in ``tasks`` partitions: a block with the queries (vec_id, v, cell, group,
    slice, floor) of its groups, a slice of them at a time."""

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        own, group, floor, ids = (t.column(c).combine_chunks() for t, c in ((asked, "vec_id"), (asked, "cell"), (asked, "floor"), (data, "vec_id")))
        own, group, floor, ids = own.to_numpy(), group.to_numpy(), floor.fill_null(NONE).to_numpy(), ids.to_numpy()
        q, v = (t.column("v").combine_chunks() for t in (asked, data))
        width = len(v[0])
        v = matrix(v, width)
        kept = few_of_equal(ids, v)
        best = search(matrix(q, width), own, floor, v[kept], ids[kept], group)
        query, slot = np.nonzero((best.id != NO_ID) & (best.score >= floor[:, None]))
        return pa.table({"query_id": own[query], "vec_id": best.id[query, slot], "score": best.score[query, slot]})

    each = pairs.select("group", "block", "slice")
    asked = queries.join(F.broadcast(each.drop("slice")), "group").select("block", "slice", "vec_id", "v", "cell", "floor")
    data = placed.join(F.broadcast(each.select("block", "slice").distinct()), "block").select("block", "slice", "vec_id", "v")
    asked, data = (x.repartition(tasks, "block", "slice").groupBy("block", "slice") for x in (asked, data))
    return asked.cogroup(data).applyInArrow(run, FOUND)


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def top_k(vectors: DataFrame, is_query=None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the K candidates of the largest integer inner product of each
    query (all, if fewer), other than the query itself, ties to the smaller vec_id.

    ``is_query``: a condition on vec_id (divisible by 50 by default). A vec_id should be unique; of rows with one id, all are
    candidates for other ids, and the smallest vector is the query. Vectors of another length than most are left out.
    """
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    points = quantised(vectors)
    width = points.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most")).orderBy(F.desc("count"), "n").limit(1).collect()
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = whole_type(width[0]["least"] or 0, width[0]["most"] or 0)
    points = points.where(F.size("v") == width[0]["n"]).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    total = width[0]["count"]
    share = min(1.0, 2.0 * SAMPLE / total)
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = points.where(mark).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    net = centres(matrix(sample["v"].combine_chunks() if isinstance(sample["v"], pa.ChunkedArray) else sample["v"], width[0]["n"]).astype(np.float64), CENTRES)
    # parts of a cell so that even one that holds most rows is cut into blocks of bounded size
    index = written(dealt(points, net, kind))
    size = index.groupBy("cell").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / min(max(BLOCK, total // SHARE), MOST))).select("cell", "cuts")
    placed = index.join(F.broadcast(size), "cell").withColumn("block", F.concat_ws(".", "cell", F.pmod("part", "cuts").cast("string")))
    asked = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "far")).alias("x"))
    queries = written(asked.select("vec_id", "x.v", "x.cell", "x.far"))
    slices = max(1, -(-queries.count() // MOST))
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")).withColumn("group", F.concat_ws(".", "cell", "slice"))
    groups = queries.groupBy("group", "slice").agg(F.max("far").alias("reach"), F.first("cell").alias("of"))
    cross = net @ net.T
    norm = np.sqrt((net**2).sum(1))
    spark = vectors.sparkSession
    bound = spark.createDataFrame(
        [(a, b, float(cross[a, b]), float(norm[a]), float(norm[b])) for a in range(len(net)) for b in range(len(net))], "of long, cell long, dot double, qn double, cn double"
    )
    summary = placed.groupBy("block", "cell").agg(F.max("far").alias("radius"))
    parts = F.col("qn") * F.col("radius") + F.col("cn") * F.col("reach") + F.col("radius") * F.col("reach")
    # with a margin for the rounding of the bound's own sums
    hope = F.col("dot") + parts + 1 + 1e-9 * (F.abs("dot") + parts)
    pairs = groups.join(F.broadcast(bound), "of").join(summary, "cell").withColumn("hope", hope).select("group", "slice", "block", "hope")
    pairs = written(pairs)
    # work is with the products, not the bytes, by which Spark would make fewer tasks
    tasks = max(_width(vectors), min(2 * CENTRES, total // BLOCK))
    # first the blocks that promise most, for a k-th score of every query
    first = pairs.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("hope"), "block"))).where(F.col("place") <= FIRST)
    near = written(_searched(first, queries.withColumn("floor", F.lit(None).cast("long")), placed, tasks))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == K).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    known = written(queries.join(kth, "vec_id", "left"))
    worst = known.groupBy("group").agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst"))
    rest = pairs.join(first, ["group", "block"], "left_anti").join(worst, "group").where(F.col("worst").isNull() | (F.col("hope") >= F.col("worst")))
    far = _searched(rest, known, placed, tasks)
    both = near.union(far).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= K)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
