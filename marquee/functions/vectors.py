"""Vector columns and nearest neighbours.

One cosine per row is a column expression. Many vectors against many rows is a matrix product, done with numpy inside the
tasks on pairs of blocks, each with a fixed number of vectors.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import col

#: Requests or exemplars of one block, and rows of an index in one.
BLOCK = 1024
ROWS = 4096


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(col(a), lambda x: x / length)


def cosine(a, b) -> Column:
    """Null when the second vector is zero: such a query has no scores."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.nullif(norm(b), F.lit(0.0)))


def _matrix(rows) -> np.ndarray:
    m = np.asarray(rows, dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _batch_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _matrix(flat.reshape(len(column), -1))


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, matrix): `size` rows of (key, embedding) in one, the vectors at unit length. A task fills blocks over its batches and input
    files, so it leaves one smaller block at most."""
    def pack(batches):
        def block():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                                              names=["ids", "matrix"])

        ids, parts = [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - len(ids))
                ids += part.column(0).to_pylist()
                parts.append(_batch_matrix(part.column(1)))
                at += part.num_rows
                if len(ids) == size:
                    yield block()
                    ids, parts = [], []
        if ids:
            yield block()

    return rows.where(F.col("embedding").isNotNull()).select(F.col(key).cast("bigint"), "embedding").mapInArrow(pack, "ids ARRAY<BIGINT>, matrix BINARY")


def block_pairs(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Every block of `rows` with every block of `others` (other_ids, other_matrix): blocks meet in shares of the first, as many as the
    session has shuffle partitions."""
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    told = others.select(F.col("ids").alias("other_ids"), F.col("matrix").alias("other_matrix"), dealt)
    return rows.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).join(told, "share").drop("share")


def _pairs_of(batches):
    """(ids, other ids, similarities) of every pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, matrix, others, other = (batch.column(c)[i].as_py() for c in ("ids", "matrix", "other_ids", "other_matrix"))
            left, right = (np.frombuffer(m).reshape(len(k), -1) for m, k in ((matrix, ids), (other, others)))
            yield np.array(ids), np.array(others), np.round(left @ right.T, 6)


def nearest_in_blocks(queries: DataFrame, index: DataFrame, k: int, floor: float) -> DataFrame:
    """(query_id, id, similarity): per block of the index the best k rows of every query at or above the floor.

    Queries and index are packed to blocks inside their own tasks; only blocks are joined, the index is read once, and neither
    goes through the driver.
    """
    def scan(batches):
        for rows, asked, sims in _pairs_of(batches):
            found = []
            for j, query in enumerate(asked):
                keep = np.flatnonzero(sims[:, j] >= floor)
                if len(keep) > k:
                    keep = keep[np.lexsort((rows[keep], -sims[keep, j]))[:k]]
                found.append((np.full(len(keep), query, dtype=np.int64), rows[keep], sims[keep, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "id", "similarity"])

    asked = packed(queries.where(norm("embedding") > 0), "query_id", BLOCK)
    return block_pairs(packed(index, "id", ROWS), asked).mapInArrow(scan, "query_id BIGINT, id BIGINT, similarity DOUBLE")


def nearest_exemplar(titles: DataFrame, exemplars: DataFrame) -> DataFrame:
    """The best exemplar of every row: (id, parent, similarity), ties to the lower ord. Any number of exemplars."""
    def scan(batches):
        for rows, ords, sims in _pairs_of(batches):
            order = np.argsort(ords, kind="stable")
            best = order[sims[:, order].argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ords[best]), pa.array(sims[np.arange(len(rows)), best])],
                                             names=["id", "ord", "similarity"])

    pairs = block_pairs(packed(titles, "id", ROWS), packed(exemplars, "ord", BLOCK))
    best = pairs.mapInArrow(scan, "id BIGINT, ord BIGINT, similarity DOUBLE").groupBy("id").agg(
        F.max(F.struct("similarity", (-F.col("ord")).alias("turn"))).alias("best"))
    return best.join(exemplars.select((-F.col("ord")).cast("bigint").alias("_turn"), "parent"), F.col("best.turn") == F.col("_turn")).select(
        "id", "parent", "best.similarity")
