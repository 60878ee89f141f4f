"""A Merkle manifest of a table: a hash per row, a tree per group, a tree over the groups, a proof per row.

H is the lowercase hex sha256 of its inputs' text, one after the other. A leaf is H of a row's columns, each `-` if null, else its number
of UTF-8 bytes, `:` and the value. Per group leaves come in order; while several nodes remain, runs of `arity` consecutive ones (the
last may be shorter, down to one) become their H. What remains is the group's subroot; subroots, null group first and then by bytes,
become the root in the same way. A proof lists, level by level, what stands left and right of the row's node in its run.

Levels are lag and lead windows. At level l the nodes sit on every arity^l-th leaf, their first descendant; the others of a node's run
are lags and leads by multiples of arity^l, masked by the node's slot and the run's length, and a run's first child hashes the
parent in place. A window spans `CHUNK` leaves or fewer, so a group of any size is dealt out in chunks, all levels of a chunk share one
shuffle, and the chunks' nodes are the leaves of the next stage. A leaf finds its ancestors' siblings as the last ones at or before it.

Places in a group are numbered without a window over the group: rows are sorted by range, and each sorted piece adds the number of
rows before it. Intermediate tables are written to the shared folder; only one number per stage reaches the driver.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import quoted, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Leaves of one window, at most.
CHUNK = 512
#: Bits of monotonically_increasing_id below the partition's number.
ROW_BITS = 33

PATH = "array<struct<left:string,right:string>>"


def _sha(*texts: Column) -> Column:
    return F.sha2(F.concat_ws("", *texts), 256)


def leaf(*values: Column) -> Column:
    """H of a row's values."""
    told = [v.cast("string") for v in values]
    return _sha(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in told])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `at`, the place within the group in the given order (from 0), and `n`, the group's size. Groups are not null;
    equal rows get places one after the other."""
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(spread.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("piece", F.shiftright("place", ROW_BITS))
    runs = placed.groupBy(group, "piece").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per group and sorted piece
    starts = runs.select(group, "piece", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).alias("shift"),
                         F.sum("size").over(whole).alias("n"))
    return placed.join(starts, [group, "piece"]).withColumn("at", F.col("place") + F.col("shift")).drop("place", "piece", "shift")


def _levels(arity: int, chunk: int) -> int:
    levels = 1
    while arity ** (levels + 1) <= chunk:
        levels += 1
    return levels


def _hashed(nodes: DataFrame, group: str, arity: int, levels: int) -> DataFrame:
    """`nodes` (group, at, n, hash and others) with `chunk`, for each level `side<l>` (the node's siblings, on the row that stands for
    the node) and `top` (the chunk's node after all levels, on its first row)."""
    over = f"OVER (PARTITION BY {group}, chunk ORDER BY at)"
    out = nodes.selectExpr("*", f"at div {arity ** levels} AS chunk", "hash AS node0")
    for level in range(levels):
        step, node = arity ** level, f"node{level}"
        slot, last = f"(at div {step}) % {arity}", f"n <= {step}"
        lefts = [f"CASE WHEN {slot} >= {j} THEN lag({node}, {j * step}) {over} END" for j in range(arity - 1, 0, -1)]
        rights = [f"CASE WHEN {slot} + {j} < {arity} AND at + {j * step} < n THEN lead({node}, {j * step}) {over} END" for j in range(1, arity)]
        met = out.selectExpr("*", *[f"{e} AS _l{i}" for i, e in enumerate(lefts)], *[f"{e} AS _r{i}" for i, e in enumerate(rights)])
        left, right = (", ".join(f"_{c}{i}" for i in range(arity - 1)) for c in "lr")
        side = (f"CASE WHEN at % {step} = 0 AND NOT {last} THEN named_struct('left', concat_ws('', {left}), 'right', concat_ws('', {right})) END")
        parent = f"CASE WHEN {last} THEN {node} WHEN at % {step * arity} = 0 THEN sha2(concat_ws('', {node}, {right}), 256) END"
        others = [c for c in out.columns if c != node]
        out = met.selectExpr(*others, f"{side} AS side{level}", f"{parent} AS node{level + 1}")
    return out.withColumnRenamed(f"node{levels}", "top")


def _stages(nodes: DataFrame, group: str, arity: int, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each stage begins with, and (group, root)."""
    levels, stages = _levels(arity, chunk), []
    while True:
        stages.append(nodes)
        hashed, span = _hashed(nodes.select(group, "at", "n", "hash"), group, arity, levels), arity ** levels
        nodes = stored(hashed.where(f"at % {span} = 0").selectExpr(group, "chunk AS at", f"(n + {span - 1}) div {span} AS n", "top AS hash"), "nodes")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return stages, nodes.select(group, F.col("hash").alias("top"))


def _paths(stages: list[DataFrame], above: DataFrame, group: str, arity: int, chunk: int) -> DataFrame:
    """The first stage's rows with `path`, and the columns of `above` (group, path and others), whose paths go on where the group's end."""
    levels, carried = _levels(arity, chunk), [c for c in above.columns if c not in (group, "path")]
    up = above.select(group, F.lit(0).cast("long").alias("chunk"), F.col("path").alias("rest"), *carried)
    so_far = f"OVER (PARTITION BY {group}, chunk ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for nodes in reversed(stages):
        filled = _hashed(nodes, group, arity, levels).selectExpr(*nodes.columns, "chunk", *[f"last(side{i}, true) {so_far} AS side{i}" for i in range(levels)])
        own = f"array_compact(array({', '.join(f'side{i}' for i in range(levels))}))"
        found = filled.join(up, [group, "chunk"]).selectExpr(*nodes.columns, f"concat({own}, rest) AS path", *carried)
        up = found.selectExpr(group, "at AS chunk", "path AS rest", *carried)
    return found


def manifest(leaves: DataFrame, group: str, order: list[str], arity: int = ARITY, chunk: int = CHUNK) -> DataFrame:
    """`leaves` (hash, group, order columns and any others but at, n, chunk, top, path, subroot, root) with subroot, root and proof: an
    array, level by level from the leaf to the root, of what stands `left` and `right` of the node in its run (either may be empty).

    `group` may be null and forms a group then; within a group rows come by `order`, nulls first, then by hash; equal rows follow one
    another. No rows: no rows.
    """
    if arity < 2 or chunk < arity:
        raise ValueError("a run needs two nodes, and a chunk a run")
    spark = leaves.sparkSession
    tied = stored(leaves.withColumn("grp", F.coalesce(F.concat(F.lit("1"), quoted(group).cast("string")), F.lit("0")))
                  .withColumn("tie", F.monotonically_increasing_id()), "leaves")
    rows = numbered(tied, "grp", [*order, "hash", "tie"]).drop("tie")
    stages, subroots = _stages(rows, "grp", arity, chunk)
    groups = numbered(subroots.select(F.lit("0").alias("all"), "grp", F.col("top").alias("hash")), "all", ["grp"])
    over, root = _stages(groups, "all", arity, chunk)
    end = root.select("all", F.from_json(F.lit("[]"), PATH).alias("path"), F.col("top").alias("root"))
    tops = stored(_paths(over, end, "all", arity, chunk).select("grp", "path", F.col("hash").alias("subroot"), "root"), "tops")
    found = _paths(stages, tops, "grp", arity, chunk)
    return found.select(*[quoted(c) for c in leaves.columns], "subroot", "root", F.col("path").alias("proof"))


def folded(hashed: Column, proof: Column) -> Column:
    """The root that a leaf's hash and a proof lead to."""
    return F.aggregate(proof, hashed, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def documents_manifest(docs: DataFrame, arity: int = ARITY, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, changed (the leaf of the row tampered with, null where it isn't), subroot, root and proof.

    A tree per lang, leaves by doc_id. Where 7 divides the unsigned crc32 of the decimal doc_id, tampering adds one to n_chars; a null
    n_chars stays, and so does a row without doc_id. Nulls in any column are leaves' `-`; rows without doc_id come first; repeated rows are
    leaves of their own. Other columns are not read, whatever their names.
    """
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = {c: F.col(c) for c in COLUMNS} | {"n_chars": F.col("n_chars") + 1}
    leaves = docs.select("doc_id", "lang", leaf(*[F.col(c) for c in COLUMNS]).alias("hash"), F.when(touched, leaf(*more.values())).alias("changed"))
    return manifest(leaves, "lang", ["doc_id"], arity, chunk).select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "root", "proof")


def verified_rows(docs: DataFrame, arity: int = ARITY, chunk: int = CHUNK) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256 (H of the proof's hashes), folded_root (from the row as tampered with)
    and verified, whether that is the root."""
    again = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    hashes = F.transform("proof", lambda s: F.concat(s["left"], s["right"]))
    return (documents_manifest(docs, arity, chunk)
            .select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(hashes, ""), 256).alias("proof_sha256"), again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
