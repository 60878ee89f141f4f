"""Hard negatives by Fagin's threshold algorithm: for each anchor its nearest rows of the same label, and for each of these the best rows
of other labels whose score lies in a window below it.

Vectors become whole numbers, floor(scale * x); a score is the integer inner product, ties go to the smaller vec_id. The rows are dealt by
hash into blocks of at most about `CELLS` components. A block keeps, for each dimension, the list of its rows by that component. An anchor
reads the lists from the end its own component's sign favours, all to the same depth; every row met is scored in full (random access). No
row not met yet can score above the threshold, the product of the anchor with the components at that depth. A window (from `low` to
`high` of a positive's score) is done once the threshold is strictly below its k-th score, so that ties are met, or below the window;
an anchor is done with a block once all its windows are. A task goes through several blocks and takes each window's best rows along.

Every row is in some block's lists and nothing is cut: where vectors are too spread out for the threshold to fall, all rows are scored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score as hundredths of the positive's, both included.
LOW, HIGH = 30, 90
#: Components of one block of rows, and anchors of one block of anchors.
CELLS, ANCHORS = 1 << 19, 1024
#: Tasks that share the blocks of rows against one block of anchors.
GROUPS = 24
#: Depth of the first stop on the lists, and how many times as deep the next one is.
DEPTH, DEEPER = 32, 4

LISTS = "ids BINARY, labels BINARY, points BINARY, lists BINARY"
SIDE = "a_row BINARY, a_ids BINARY, a_labels BINARY, a_points BINARY, a_scores ARRAY<ARRAY<LONG>>"


def taking_part(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, point, dim) of the rows that take part, repeated rows once."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.forall(number, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(number, lambda x: F.floor(F.lit(float(scale)) * x)).alias("point"), F.size("embedding").cast("long").alias("dim")).distinct()


def _cut(rows: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """`rows` with `cut`: within each key, a hash block of at most about `most` rows."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, keys).withColumn("cut", F.pmod(F.xxhash64("vec_id", "point"), F.ceil(F.col("size") / most))).drop("size")


def _matrix(points: pd.Series) -> np.ndarray:
    return np.stack(points.to_list()).astype("<i8")


def sorted_lists(rows: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """One row per block: its rows, and for each dimension their numbers by ascending component."""
    def block(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(some["point"])
        lists = np.argsort(points, axis=0, kind="stable").astype("<i4")
        return pd.DataFrame([[*key, some["vec_id"].to_numpy("<i8").tobytes(), some["label"].to_numpy("<i8").tobytes(), points.tobytes(), lists.tobytes()]],
                            columns=[*keys, "cut", "ids", "labels", "points", "lists"])

    most = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("dim")))
    return _cut(rows, keys, most).groupBy(*keys, "cut").applyInPandas(block, ", ".join([*(f"{k} LONG" for k in [*keys, "cut"]), LISTS]))


def anchor_blocks(anchors: DataFrame, keys: list[str], most: int = ANCHORS) -> DataFrame:
    """One row per block of anchors (anchor, vec_id, label, point, dim, scores)."""
    def block(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        told = [some[c].to_numpy("<i8").tobytes() for c in ("anchor", "vec_id", "label")]
        return pd.DataFrame([[*key, *told, _matrix(some["point"]).tobytes(), [list(s) for s in some["scores"]]]],
                            columns=[*keys, "number", *(c.split()[0] for c in SIDE.split(", "))])

    return (_cut(anchors, keys, F.lit(most)).withColumnRenamed("cut", "number").groupBy(*keys, "number")
            .applyInPandas(block, ", ".join([*(f"{k} LONG" for k in [*keys, "number"]), SIDE])))


class Lists:
    """A block's rows and sorted lists."""

    def __init__(self, ids: bytes, labels: bytes, points: bytes, lists: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.points = np.frombuffer(points, "<i8").reshape(-1, dim)
        self.lists = np.frombuffer(lists, "<i4").reshape(-1, dim)
        self.most = float(np.abs(self.points).max())
        self.floats = self.points.astype(np.float64)
        n = len(self.ids)
        self.depths = [d for d in (DEPTH * DEEPER ** i for i in range(40)) if d < n] + [n]

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor what no row can exceed that is not met at each of the depths; nothing is left at the last one."""
        out = np.full((len(anchors), len(self.depths)), -np.inf)
        up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
        every = np.arange(self.points.shape[1])
        for i, depth in enumerate(self.depths[:-1]):
            high = self.floats[self.lists[len(self.ids) - 1 - depth], every]
            low = self.floats[self.lists[depth], every]
            bound = up @ high + down @ low
            out[:, i] = bound + 1e-9 * np.abs(bound)  # exact below 2^53, safe above
        return out

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(anchor).max()) * len(anchor) < 2.0 ** 53:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.points[rows] @ anchor


class Best:
    """A window's k best rows so far."""

    def __init__(self, low: float, high: float, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.floor) & (scores <= self.high)
        if fit.any():
            scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
            first = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[first], ids[first]
            if len(first) == self.k:
                self.floor = max(self.low, int(self.scores[-1]))


def threshold_search(lists: Lists, anchor: np.ndarray, own: int, allowed: np.ndarray, thresholds: np.ndarray, windows: list[Best]) -> int:
    """Offers the windows every allowed row that may be among their best; the number of rows scored."""
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    open_rows, n, done, scored = allowed & (lists.ids != own), len(lists.ids), 0, 0
    for depth, bound in zip(lists.depths, thresholds):
        if depth == n:
            rows = np.flatnonzero(open_rows)
        else:
            met = np.zeros(n, bool)
            met[lists.lists[n - depth:n - done, up].ravel()] = True
            met[lists.lists[done:depth, down].ravel()] = True
            rows = np.flatnonzero(met & open_rows)
        if len(rows):
            open_rows[rows] = False
            scored += len(rows)
            scores, ids = lists.scores(rows, anchor), lists.ids[rows]
            for window in windows:
                window.offer(scores, ids)
        if all(bound < window.floor for window in windows):
            break
        done = depth
    return scored


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score of a negative: low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def _best_rows(blocks: DataFrame, anchors: DataFrame, keys: list[str], same: bool, k: int, low: int, high: int, groups: int) -> DataFrame:
    """(anchor, positive_score, vec_id, score, place): per anchor and window its k best rows of the same label (one window without
    bounds, positive_score null) or of other labels (a window per score in a_scores). Ties to the smaller vec_id."""
    names = [c.split()[0] for c in SIDE.split(", ")]
    pairs = (blocks.join(anchors.select(*keys, "number", *names), keys).withColumn("grp", F.pmod(F.xxhash64("cut"), F.lit(groups)))
             .repartition(*keys, "number", "grp").sortWithinPartitions(*keys, "number", "grp"))
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "positive_score", "vec_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            rows = [(int(row), score, int(i), int(s)) for row, mine in zip(side["row"], side["windows"]) for score, best in mine
                    for s, i in zip(best.scores, best.ids)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        now, side = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                key, dim = tuple(row[c].as_py() for c in [*keys, "number"]), row["dim"].as_py()
                if key != now:
                    if side:
                        yield results()
                    now, scores = key, row["a_scores"].as_py()
                    side = {c: np.frombuffer(row["a_" + c].as_py(), "<i8") for c in ("row", "ids", "labels", "points")}
                    side["points"] = side["points"].reshape(-1, dim)
                    side["windows"] = [[(None, Best(-np.inf, np.inf, k))] if same else [(s, Best(*window(s, low, high), k)) for s in sorted(set(some))]
                                       for some in scores]
                lists = Lists(*(row[c.split()[0]].as_py() for c in LISTS.split(", ")), dim)
                bounds = lists.thresholds(side["points"])
                for i, mine in enumerate(side["windows"]):
                    if wanted := [best for _, best in mine if best.low <= best.high]:
                        allowed = (lists.labels == side["labels"][i]) == same
                        threshold_search(lists, side["points"][i], side["ids"][i], allowed, bounds[i], wanted)
        if side:
            yield results()

    found = pairs.mapInArrow(search, "anchor LONG, positive_score LONG, vec_id LONG, score LONG")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, cells: int = CELLS, most: int = ANCHORS, groups: int = GROUPS) -> DataFrame:
    """For every anchor (a row vec_id, label, embedding) and each of its `positives` best rows of `vectors` with the same label and another
    vec_id: the `negatives` best rows of another label (and another vec_id) whose score is from `low` to `high` hundredths of the
    positive's. anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, or a null, empty or non-finite vector, take no part on either side. Vectors meet those of their own
    length. Repeated rows count once; a vec_id with several vectors or labels is a row for each. Fewer rows than asked for: all of them.
    A positive without any negative in its window gives no row; a positive's score below zero has an empty window. Empty tables give no
    rows. Other columns are not read. Scores are exact while they fit 64 bits. `cells`, `most` and `groups` deal out the work and change
    no result.
    """
    rows = stored(taking_part(vectors, scale), "rows")
    asked = stored(taking_part(anchors, scale).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    none = F.array().cast("array<long>")

    keys = ["dim", "label"]
    wanted = rows.join(asked.select(*keys).distinct(), keys, "left_semi")
    found = _best_rows(sorted_lists(wanted, keys, cells), anchor_blocks(asked.withColumn("scores", none), keys, most), keys, True, positives, low, high, groups)
    near = stored(found.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    told = asked.join(near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores")), "anchor")
    keys = ["dim"]
    wanted = rows.join(told.select(*keys).distinct(), keys, "left_semi")
    far = _best_rows(sorted_lists(wanted, keys, cells), anchor_blocks(told, keys, most), keys, False, negatives, low, high, groups)
    ids = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return near.join(far, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
