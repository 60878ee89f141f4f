"""Exact top-k by inner product with two cover trees: one over a block of queries, one over a block of data.

Vectors are turned to whole numbers, floor(scale * x). Equal vectors are one point with its k + 1 smallest ids: by the tie rule no
other id of that point can be among any query's k best. Points are dealt to the nearest of a bounded number of pivots and cut into
blocks of about `BLOCK`, so a block lies together and no block grows with the data. A block's cover tree halves its
radius from level to level (farthest-first nets: nested, covering, separated) and keeps each node's true covering radius; where points
are too spread out for a cover of few centres, a node is a leaf.

The queries go against all blocks in blocks of their own. A pair of nodes is left when no point of one can reach, against any query of
the other, the worst k-th score of that query group: q.d <= q0.d0 + rq|d0| + rd|q0| + rq rd. A query's first k-th score is that
over the pivots' sample, a lower bound since the sample is part of the data; each task then goes on with what it found.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import stored

K = 10
SCALE = 1024
#: Points of one block, about; a task holds one block of data and one of queries.
BLOCK = 4096
#: Rows the pivots are chosen from and first scores are taken over, and the number of pivots.
SAMPLE, PIVOTS = 4096, 64
#: Points of a leaf: large enough that a pair of leaves is one matrix product worth its call.
LEAF = 256
#: A node whose cover at half its radius needs over a share of its points as centres stays a leaf, scanned by one product.
SPREAD = 32
#: Tasks that share the data blocks of one block of queries.
GROUPS = 24

TREE = "points BINARY, ids ARRAY<ARRAY<LONG>>, radius ARRAY<DOUBLE>, centre ARRAY<INT>, first ARRAY<INT>, last ARRAY<INT>, child ARRAY<INT>, children ARRAY<INT>"


class Tree:
    """Nodes as arrays; a node's points are `order[first:last]`, its children `child ... child + children - 1`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.first, self.last, self.child, self.children = [], [], [], [], [], []
        self._node(points, 0, len(points), 0)
        at = 0
        while at < len(self.centre):
            self._split(points, at, leaf)
            at += 1

    def _node(self, points, first, last, centre) -> None:
        apart = np.linalg.norm(points[self.order[first:last]] - points[centre], axis=1)
        for column, value in ((self.centre, centre), (self.radius, float(apart.max())), (self.first, first), (self.last, last),
                              (self.child, 0), (self.children, 0)):
            column.append(value)

    def _split(self, points, at, leaf) -> None:
        first, last, half = self.first[at], self.last[at], self.radius[at] / 2
        if last - first <= leaf or not half:
            return
        members = self.order[first:last]
        own = points[members]
        centres, nearest = [self.centre[at]], np.zeros(len(members), np.int64)
        apart = np.linalg.norm(own - points[centres[0]], axis=1)
        while apart[far := int(apart.argmax())] > half:
            if len(centres) >= len(members) // SPREAD:  # too spread out for a cover to help
                return
            there = np.linalg.norm(own - own[far], axis=1)
            closer = there < apart
            nearest[closer], apart[closer] = len(centres), there[closer]
            centres.append(int(members[far]))
        by_centre = np.argsort(nearest, kind="stable")
        self.order[first:last] = members[by_centre]
        ends = first + np.cumsum(np.bincount(nearest, minlength=len(centres)))
        self.child[at], self.children[at] = len(self.centre), len(centres)
        for centre, begin, end in zip(centres, [first, *ends[:-1]], ends):
            self._node(points, int(begin), int(end), centre)


class Side:
    """A tree with its points in tree order, as stored in a block's row."""

    def __init__(self, row: dict, dim: int):
        self.points = np.frombuffer(row["points"], "<i8").reshape(-1, dim)
        self.floats = self.points.astype(np.float64)
        self.ids = row["ids"]
        self.radius, self.centre, self.first, self.last, self.child, self.children = (
            np.asarray(row[c]) for c in ("radius", "centre", "first", "last", "child", "children"))
        self.middles = self.floats[self.centre]
        self.norms = np.linalg.norm(self.middles, axis=1)


def products(a: "Side", some: slice, b: "Side", others: slice) -> np.ndarray:
    """Whole-number inner products; floating point only where it is exact."""
    top = float(np.abs(a.floats[some]).max()) * float(np.abs(b.floats[others]).max()) * a.points.shape[1]
    if top < 2.0 ** 53:
        return (a.floats[some] @ b.floats[others].T).astype(np.int64)
    return a.points[some] @ b.points[others].T


class Best:
    """The k best (score, smaller id) of each query of a block so far."""

    def __init__(self, ids: list[int], floors: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, floors.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def offer(self, query: int, scores: np.ndarray, ids: list) -> None:
        mine = self.found[query]
        mine += [(-int(s), i) for s, some in zip(scores, ids) for i in some if i != self.ids[query]]
        mine.sort()
        del mine[self.k:]
        if len(mine) == self.k:
            self.worst[query] = max(self.worst[query], -mine[-1][0])


def dual_search(queries: Side, data: Side, best: Best) -> None:
    """Offers `best` every point of `data` that may be among a query's k best, and few others."""
    def reach(q, d):
        bound = (queries.middles[q] @ data.middles[d].T + np.outer(queries.radius[q], data.norms[d])
                 + np.outer(queries.norms[q], data.radius[d]) + np.outer(queries.radius[q], data.radius[d]))
        return bound + 1e-9 * np.abs(bound) + 1e-6

    pairs = [(0, 0, np.inf)]
    while pairs:
        q, d, bound = pairs.pop()
        some = slice(queries.first[q], queries.last[q])
        if bound < best.worst[some].min():
            continue
        if not queries.children[q] and not data.children[d]:
            others = slice(data.first[d], data.last[d])
            scores = products(queries, some, data, others)
            enough = scores >= best.worst[some][:, None]
            for i in np.flatnonzero(enough.any(axis=1)):
                hits = np.flatnonzero(enough[i])
                best.offer(some.start + i, scores[i, hits], [data.ids[others.start + h] for h in hits])
            continue
        split_data = data.children[d] and (not queries.children[q] or data.radius[d] >= queries.radius[q])
        kids = (data if split_data else queries).child[d if split_data else q] + np.arange(
            (data if split_data else queries).children[d if split_data else q])
        bounds = (reach([q], kids) if split_data else reach(kids, [d])).ravel()
        for i in np.argsort(bounds):
            pairs.append((q, kids[i], bounds[i]) if split_data else (kids[i], d, bounds[i]))


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, point, dim) of the rows that take part: an id, and a vector without null or non-finite components."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(
        number, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"),
                                         F.transform(number, lambda x: F.floor(F.lit(float(scale)) * x)).alias("point"),
                                         F.size("embedding").alias("dim")))


def _pivots(sample: dict[int, np.ndarray], pivots: int) -> dict[int, np.ndarray]:
    """Farthest-first points of each dimension's sample."""
    out = {}
    for dim, points in sample.items():
        chosen, apart = [points[0]], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < pivots and apart.max() > 0:
            chosen.append(points[int(apart.argmax())])
            apart = np.minimum(apart, np.linalg.norm(points - chosen[-1], axis=1))
        out[dim] = np.array(chosen)
    return out


def _nearest(pivots: dict[int, np.ndarray], point: Column) -> Column:
    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        out = np.zeros(len(points), np.int32)
        sizes = points.map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim in pivots:
                rows = np.flatnonzero(sizes == dim)
                own, middles = np.stack(points.iloc[rows].to_list()).astype(np.float64), pivots[dim]
                for at in range(0, len(rows), 8192):
                    part = own[at:at + 8192]
                    out[rows[at:at + 8192]] = ((middles ** 2).sum(axis=1) - 2 * part @ middles.T).argmin(axis=1)
        return pd.Series(out)

    return nearest(point)


def _trees(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block of (point, ids): its cover tree with the points in tree order."""
    names = [*keys, *(c.split()[0] for c in TREE.split(", "))]

    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows["point"].to_list()).astype("<i8")
        built = Tree(points.astype(np.float64))
        place = np.empty(len(points), np.int64)
        place[built.order] = np.arange(len(points))
        ids = rows["ids"].to_list()
        return pd.DataFrame([[*key, points[built.order].tobytes(), [list(ids[i]) for i in built.order], built.radius,
                              place[built.centre].tolist(), built.first, built.last, built.child, built.children]], columns=names)

    return blocks.groupBy(*keys).applyInPandas(tree, ", ".join([*(f"{k} LONG" for k in keys), TREE]))


def nearest(data: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, sample: int = SAMPLE,
            pivots: int = PIVOTS, groups: int = GROUPS) -> DataFrame:
    """For every query (a row vec_id, embedding) its k highest scores against the rows of `data` with another vec_id, ties to the
    smaller vec_id: query_id, rank (from 1), vec_id, score.

    Rows with a null id, or a null, empty or non-finite vector, take no part, on either side. Vectors meet those of their own
    length. Repeated rows count once; a vec_id that comes with several vectors is a row for each of them. Fewer candidates than k:
    all of them. Other columns are not read. `sample` and `pivots` bound what the driver sees; they change no result.
    """
    rows = whole_numbers(data, scale).distinct()
    first = Window.partitionBy("point").orderBy("vec_id")
    points = stored(rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
                    .groupBy("point", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    drawn = points.orderBy(F.xxhash64("point")).limit(sample).collect()
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(row["dim"], []).append(row)
    known = {dim: np.array([r["point"] for r in some], dtype=np.float64) for dim, some in by_dim.items()}
    place_of = {dim: {i: at for at, r in enumerate(some) for i in r["ids"]} for dim, some in by_dim.items()}

    placed = points.withColumn("pivot", _nearest(_pivots(known, pivots), F.col("point")))
    sizes = placed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("size"))
    cut = F.pmod(F.xxhash64("point", F.lit(1)), F.ceil(F.col("size") / block))
    data_trees = stored(_trees(placed.join(sizes, ["dim", "pivot"]).select(
        F.col("dim").cast("long").alias("dim"), F.col("pivot").cast("long").alias("pivot"), cut.alias("cut"), "point", "ids"),
        ["dim", "pivot", "cut"]), "data_trees")

    asked = whole_numbers(queries, scale).distinct()
    numbers = max(1, -(-asked.count() // block))
    asked = asked.select(F.col("dim").cast("long").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(numbers)).alias("number"),
                         "point", F.array("vec_id").alias("ids"))
    query_trees = stored(_trees(asked, ["dim", "number"]), "query_trees")

    left = [F.col(c.split()[0]).alias("q_" + c.split()[0]) for c in TREE.split(", ")]
    pairs = (data_trees.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))
             .withColumn("group", F.pmod(F.xxhash64("pivot", "cut"), F.lit(groups)))
             .join(query_trees.select("dim", "number", *left), ["dim", "number"])
             .repartition("dim", "number", "group").sortWithinPartitions("dim", "number", "group"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            rows = [(best.ids[i], vec, -score) for i, some in enumerate(best.found) for score, vec in some]
            columns = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        now, best, side = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim, key = row["dim"], (row["dim"], row["number"])
                if key != now:
                    if best:
                        yield results()
                    now = key
                    side = Side({c[2:]: v for c, v in row.items() if c.startswith("q_")}, dim)
                    ids = [some[0] for some in side.ids]
                    best = Best(ids, floors(side, ids, dim), k)
                dual_search(side, Side(row, dim), best)
        if best:
            yield results()

    def floors(side: Side, ids: list[int], dim: int) -> np.ndarray:
        """Each query's k-th best score over the sample, one id per point; minus infinity where the sample has fewer."""
        out = np.full(len(ids), -np.inf)
        if dim not in known:
            return out
        others = Side({"points": known[dim].astype("<i8").tobytes(), "ids": [], "radius": [], "centre": np.empty(0, np.int64),
                       "first": [], "last": [], "child": [], "children": []}, dim)
        scores = products(side, slice(None), others, slice(None)).astype(np.float64)
        for at, own in enumerate(place_of[dim].get(i) for i in ids):
            if own is not None:
                scores[at, own] = -np.inf
        if scores.shape[1] >= k:
            out = np.partition(scores, -k, axis=1)[:, -k]
        return out

    found = pairs.mapInArrow(search, "query_id LONG, vec_id LONG, score LONG")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
