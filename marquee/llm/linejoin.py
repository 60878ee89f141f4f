"""Lines that repeat earlier lines, by an exact set-similarity join of DataFrame operations only.

A line is what stands between line feeds; its tokens are the distinct pieces between blanks. Lines come in the order of (doc_id, line
number), rows without doc_id last, each by itself. A line with tokens is removed if an earlier line's tokens have a Jaccard similarity of at least `SIMILARITY` with its own,
whether that earlier line stays or not. Lines without tokens stay.

1. Rarity: occurrences of all tokens of all texts are counted in `BUCKETS` hash buckets. A token's key is its bucket's count, in steps
   of a power of 1.5, above 57 bits of its hash: the same total order, rare tokens first, for every line.
2. Lines with the same tokens are one set, with the first of its lines; all others of them repeat it.
3. In that order two tokens stand next to each other in both of two similar sets, and do so `SHARED` times among the first tokens of either: each
   token that only one of them has parts one pair of common neighbours at most (prefix filter on neighbours; two tokens say far more than one, and
   what rare neighbours meet are few). Rows (neighbours, set) meet once, under the length filter: each set with the first that has the same
   neighbours and with the one before it. Where more than three meet, the others are left for the second round.
   A parity filter follows: 128 bits, each turned over by every token that falls on it, differ in no more bits than the sets do in tokens.
4. Pairs are verified on all their tokens (64 bits of each), read from the texts again; only lines that a fixed-size bitmap of the wanted ones lets through are read.
   A first round holds each set only against those it met so, and of a crowd of similar lines most are settled in proportion to
   their number. Then what is left is joined with all earlier sets, which finds every match.

Rows of the same neighbours may be many: joins on them are split by AQE, and nothing collects them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import forget, free_name, quoted, stored

#: Similarity as a fraction.
SIMILARITY = (4, 5)
BUCKETS = 1 << 16
#: Bits of the map of wanted lines, in words of 64.
MAP_BITS = 1 << 21
#: Neighbours that similar sets are sure to share in their prefixes.
SHARED = 2
#: Similar sets of fewer tokens are equal.
LEAST = 4
#: The turn of lines without doc_id.
LAST = (1 << 63) - 1


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _turn() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _lines(docs: DataFrame, row: Column) -> DataFrame:
    """(turn, row, no, line): every line of every text; null texts have none."""
    return docs.select(_turn().alias("turn"), row.alias("row"), F.posexplode(F.split("text", "\n")).alias("no", "line"))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """`docs` with a column `row` that tells rows without doc_id apart: zero where there is one, else a number from one, given once and stored."""
    unnamed = F.col("doc_id").cast("long").isNull()
    counted = stored(docs.where(unnamed).withColumn(row, F.monotonically_increasing_id() + 1), "unnamed")
    return docs.where(~unnamed).withColumn(row, F.lit(0).cast("long")).unionByName(counted)


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> Column:
    """A literal array: for each hash bucket how common its tokens are over all texts, from 0 to 63. Its size is fixed, a power of two."""
    counts = (docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
              .groupBy(F.xxhash64("word").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    steps = ["0"] * buckets
    for row in counts.select("bucket", F.least(F.lit(63), F.floor(F.log(1.5, F.col("n") + 1))).alias("step")).collect():
        steps[row["bucket"]] = str(row["step"])
    return F.split(F.lit(",".join(steps)), ",").cast("array<int>")


def _ceil(numerator: Column, denominator: int) -> Column:
    return F.floor((numerator + (denominator - 1)) / F.lit(denominator)).cast("int")


def token_sets(docs: DataFrame, row: Column, similarity: tuple[int, int] = SIMILARITY, buckets: int = BUCKETS) -> DataFrame:
    """(id, turn, row, no, mark, n, parity, odd, prefix): one row per distinct token set with its first line, ids in the order of these; `mark` is the line's hash, which tells
    apart the lines of rows that share a doc_id. `prefix` holds 32 bits of each of its rarest tokens' keys."""
    common = rarity(docs, buckets)

    def key(hashed: Column) -> Column:
        step = F.get(common, hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")).cast("long")
        return F.shiftleft(step, 57).bitwiseOR(F.shiftrightunsigned(hashed, 7))

    keys = F.sort_array(F.transform(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))), key))
    # a filter on the keys would compute them a second time; a generator's output is a column like those of a table
    lines = _lines(docs, row).select("turn", "row", "no", F.hash("line").alias("mark"), F.explode_outer(F.array(keys)).alias("keys"))
    lines = lines.where(F.size("keys") > 0)
    n = F.size("keys")

    # of 128 bits: the parity of all tokens on 64, and of those that the seventh bit moves to the other 64
    bit, moved = F.lit(63), lambda k: _right(k, F.lit(6)).bitwiseAND(F.lit(1))
    parity, odd = (F.aggregate("keys", F.lit(0).cast("long"), lambda p, k: p.bitwiseXOR(_left(one(k), k.bitwiseAND(bit).cast("int"))))
                   for one in (lambda k: F.lit(1).cast("long"), moved))
    prefix = F.transform(F.slice("keys", F.lit(1), F.when(n < LEAST, 0).otherwise(_prefix(n, similarity))), lambda k: F.hash(k))
    told = lines.select("turn", "row", "no", "mark", F.xxhash64("keys").alias("print"), n.alias("n"), parity.alias("parity"), odd.alias("odd"),
                        prefix.alias("prefix"))
    place = F.struct("turn", "row", "no", "mark")
    return (told.groupBy("print", "parity", "odd", "n").agg(F.min(place).alias("place"), F.first("prefix").alias("prefix"))
            .select("place.*", "n", "parity", "odd", "prefix").sort("turn", "row", "no", "mark").select(F.monotonically_increasing_id().alias("id"), "*"))


def _needed(n, m, similarity: tuple[int, int]) -> Column:
    """The least overlap of sets of n and m tokens that are similar."""
    above, below = similarity
    return _ceil((n + m) * above, above + below)


def _prefix(n: Column, similarity: tuple[int, int]) -> Column:
    """The tokens of a set of n that hold `SHARED` pairs of neighbours of every similar set. Of a similar set of m, u tokens are only in the
    first, v only in the second and c in both: up to u + v pairs of common tokens are parted, u tokens stand between, so 2u + v + SHARED
    pairs suffice, and 2u + v = 2n + m - 3c, which is greatest for the least or the greatest m."""
    above, below = similarity
    if 5 * above < 4 * below:
        raise ValueError("similarities under 4/5 leave small sets with fewer common neighbours")
    most = [F.floor(((2 * n + m) * (above + below) - 3 * above * (n + m)) / F.lit(above + below))
            for m in (_ceil(n * above, below), F.floor(n * below / F.lit(above)))]
    return (F.greatest(*most) + (SHARED + 1)).cast("int")


def _fit(n, m, similarity: tuple[int, int]) -> Column:
    """Length filter."""
    return F.least(n, m) >= _needed(n, m, similarity)


def _apart(a: str, b: str) -> Column:
    """How many of the 128 bits differ."""
    odd, parity = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("odd", "parity"))
    return F.bit_count(odd) + F.bit_count(parity.bitwiseXOR(odd))


def _may_match(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Length and parity filters: sets differ in one token for each bit at least."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _fit(n, m, similarity) & (_apart(a, b) <= n + m - 2 * _needed(n, m, similarity))


def _bits(places: DataFrame, spot: Column) -> dict[int, int]:
    """The map of the spots: words of 64 bits, those that are not zero."""
    words = (places.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).cast("int").alias("at"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(spot & 63 AS INT)))").alias("bits")))
    return {r["at"]: r["bits"] for r in words.collect()}


def _bit_of(bits: dict[int, int], spot: Column) -> Column:
    """Whether the bit at `spot` of a map given as words of 64 bits is set; the map is a literal of fixed size."""
    words = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(MAP_BITS // 64))), ",").cast("array<long>")
    word = F.get(words, F.shiftright(spot, 6).cast("int"))
    return _right(word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _held(docs: DataFrame, row: Column, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, words): the tokens, 64 bits of each, of the sets in the pairs (late, early), stored."""
    wanted = pairs.select(F.col("late").alias("id")).union(pairs.select(F.col("early").alias("id"))).distinct()
    places = stored(sets.select("id", "turn", "row", "no", "mark").join(wanted, "id", "left_semi"), "places")
    text, spot = (F.pmod(F.xxhash64(*of), F.lit(MAP_BITS)) for of in (["turn", "row"], ["turn", "row", "no", "mark"]))
    some = docs.where(_bit_of(_bits(places, text), F.pmod(F.xxhash64(_turn(), row), F.lit(MAP_BITS))))
    seen = _lines(some, row).withColumn("mark", F.hash("line")).where(_bit_of(_bits(places, spot), spot))
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    texts = seen.select("turn", "row", "no", "mark", hashes.alias("words"))
    held = stored(places.join(texts, ["turn", "row", "no", "mark"]).groupBy("id").agg(F.first("words").alias("words")), "held")
    forget(places)
    return held


def _verified(held: DataFrame, pairs: DataFrame, similarity: tuple[int, int], name: str) -> DataFrame:
    """The ids (late) of the pairs (late, early) whose tokens are as similar as asked for, stored."""
    above, below = similarity
    late, early = held.select(F.col("id").alias("late"), F.col("words").alias("x")), held.select(F.col("id").alias("early"), F.col("words").alias("y"))
    met = F.size(F.array_intersect("x", "y"))
    similar = pairs.select("late", "early").join(late, "late").join(early, "early").where(met * (above + below) >= (F.size("x") + F.size("y")) * above)
    return stored(similar.select(F.col("late").alias("id")).distinct(), name)


def _likely(sets: DataFrame, pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(late, early): the pairs that places, sizes and parities leave."""
    told = F.struct(F.struct("turn", "row", "no").alias("place"), "n", "parity", "odd")
    x, y = sets.select(F.col("id").alias("early"), told.alias("x")), sets.select(F.col("id").alias("late"), told.alias("y"))
    return (pairs.join(x, "early").join(y, "late").where((F.col("x.place") < F.col("y.place")) & _may_match("x", "y", similarity))
            .select("late", "early"))


def repeats(docs: DataFrame, row: Column, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The ids of `sets` that an earlier set is similar to. Sets that begin at the same place, in rows that share a doc_id, do not
    repeat each other.

    Two rounds: each set with the first and the nearest ones under its neighbours, in proportion to the input; then, for those that leaves,
    all other pairs that pass the filters.
    """
    pair = _left(F.col("token").cast("long"), F.lit(32)).bitwiseOR(F.get("prefix", F.col("at") + 1).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    every = (sets.select("id", "n", "prefix", F.posexplode("prefix").alias("at", "token"))
             .where(F.col("at") < F.size("prefix") - 1).select(pair.alias("pair"), "id", "n"))
    order = Window.partitionBy("pair").orderBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = every.select("pair", "id", "n", F.row_number().over(order).alias("nth"),
                          F.struct(F.first("id").over(so_far).alias("id"), F.first("n").over(so_far).alias("n")).alias("first"))
    met = stored(ranked.where(F.col("nth") > 1).withColumn("before", F.lag(F.struct("id", "n")).over(order))
                 .withColumn("more", F.lead("nth", 2).over(order).isNotNull()), "met")

    others = F.when(F.col("nth") == 2, F.array("first")).otherwise(F.array("first", "before"))
    near = (met.select("id", "n", F.explode(others).alias("other")).select("id", "n", F.col("other.id").alias("early"), F.col("other.n").alias("m"))
            .where(_fit(F.col("n"), F.col("m"), similarity)))
    near = stored(near.groupBy(F.col("id").alias("late"), "early").agg(F.count(F.lit(1)).alias("shared")), "near")
    pairs = stored(_likely(sets, near.where(F.col("shared") >= SHARED).select("late", "early"), similarity), "anchored")
    held = _held(docs, row, sets, pairs)
    settled = _verified(held, pairs, similarity, "settled")
    forget(pairs, held)

    # only open sets look for an earlier one; of those under the same neighbours the first and the one before are in `near`
    crowds = stored(met.where("more OR nth > 3").select("pair", "id", "nth").join(sets.select("id", "n", "parity", "odd"), "id")
                    .join(settled.withColumn("settled", F.lit(True)), "id", "left"), "crowds")
    x, y = crowds.drop("settled").alias("x"), crowds.where("nth > 3 AND settled IS NULL").drop("settled").alias("y")
    far = x.join(y, (F.col("x.pair") == F.col("y.pair")) & (F.col("x.nth") < F.col("y.nth") - 1) & _may_match("x", "y", similarity))
    far = far.groupBy(F.col("y.id").alias("late"), F.col("x.id").alias("early")).agg(F.count(F.lit(1)).alias("shared"))
    both = near.withColumn("new", F.lit(0)).union(far.withColumn("new", F.lit(1))).groupBy("late", "early")
    found = stored(both.agg(F.sum("shared").alias("shared"), F.max("new").alias("new")).where((F.col("shared") >= SHARED) & (F.col("new") == 1))
                   .select("late", "early"), "found")
    forget(met, near, crowds)
    pairs = stored(_likely(sets, found, similarity), "pairs")
    forget(found)
    held = _held(docs, row, sets, pairs)
    more = _verified(held, pairs, similarity, "more")
    forget(pairs, held)
    out = stored(settled.union(more).distinct(), "repeats")
    forget(settled, more)
    return out


def _code(no: Column, mark: Column) -> Column:
    return F.shiftleft(no.cast("long"), 32).bitwiseOR(mark.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def without_repeats(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, buckets: int = BUCKETS) -> DataFrame:
    """The rows and columns of `docs`, the text of each without its removed lines.

    Null texts stay null, empty ones empty; a text may lose all its lines and become empty. Rows that share a doc_id are told apart by
    their lines' hashes; repeated rows come out alike. Rows without doc_id are texts of their own, after all others and in the order in
    which they are read once; each keeps a list of its own lines only.
    """
    row, key, kept, lines = (free_name(docs, name) for name in ("row_of", "kept_of", "kept_lines", "text_lines"))
    columns, docs = docs.columns, numbered(docs, row)
    sets = stored(token_sets(docs, quoted(row), similarity, buckets), "sets")
    repeated = repeats(docs, quoted(row), sets, similarity)
    stay = stored(sets.select("id", "turn", "row", "no", "mark").join(repeated, "id", "left_anti"), "stay")
    forget(sets, repeated)
    of_row = (stay.groupBy("turn", "row").agg(F.collect_list(_code(F.col("no"), F.col("mark"))).alias(kept))
              .select(F.struct("turn", "row").alias(key), quoted(kept)))
    # once the lists are over the broadcast threshold this join is shuffled anyhow; said here, small tables run as large ones do
    joined = (docs.join(of_row.hint("merge"), (_turn() == quoted(key)["turn"]) & (quoted(row) == quoted(key)["row"]), "left")
              .withColumn(lines, F.split("text", "\n")).withColumn(kept, F.coalesce(quoted(kept), F.array().cast("array<long>"))))
    codes = F.transform(quoted(lines), lambda line, no: _code(no, F.hash(line)))
    blank = F.filter(F.transform(quoted(lines), lambda line, no: F.when(F.trim(line) == "", _code(no, F.hash(line)))), lambda c: c.isNotNull())
    left = F.sort_array(F.array_union(F.array_intersect(codes, quoted(kept)), blank))
    numbers = F.transform(left, lambda c: F.shiftright(c, 32).cast("int"))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(numbers, lambda no: F.get(quoted(lines), no)), "\n"))
    return joined.withColumn("text", text).select(*[quoted(c) for c in columns])


def line_report(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, buckets: int = BUCKETS) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines before and n_kept after, and text_sha256 of the text that stays (a null text counts as empty)."""
    before = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    after = F.coalesce(F.col("text"), F.lit(""))
    return without_repeats(before, similarity, buckets).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.when(after == "", 0).otherwise(F.size(F.split(after, "\n"))).cast("long").alias("n_kept"), F.sha2(after, 256).alias("text_sha256"))
