"""Personal data in texts, by DataFrame operations only: exact base spans, and candidates that boosted trees select.

Base spans are the leftmost non-overlapping matches of one pattern per kind; matches that fail the kind's test (octets, digits, Luhn) are
dropped. Looser patterns with high recall propose further spans, which may overlap each other and the base. Gradient-boosted
trees judge each from its format (lengths, digits, separators, grouping) and its context (the characters and cue words around
it), not from the kinds' tests. They learn from the base: a candidate that overlaps a base span of its kind is personal data, any other is
not. They are fitted by Spark on every candidate of one half, told by a hash; on all of the other half the threshold is
calibrated: the lowest score from which on the share of true candidates is at least `PRECISION`. Candidates that reach it are added.

Start and end are code points, end exclusive. A pattern's matches and the gaps between them are taken from the whole text;
only these, never texts, are shuffled, one row per match, so many matches in one text are no burden.
"""

from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
CONTEXT = 24
TREES, DEPTH = 8, 3
#: Ranges of scores that are summed up by themselves.
RANGES = 1024

# Loops that nothing behind them could make shorter are possessive: the same matches, without stack or retries. A start within a run is only
# tried where the last match ended, for the run's first character would have matched as well.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"[0-9](?:[ .-]{0,2}[0-9]){11,}+",
    "phone": r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
}
CUES = {"email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|addr|login", "card": "card|visa|credit|karte|carte|tarjeta",
        "phone": "tel|phone|call|fax|mobil|ruf"}


def _luhn(digits: Column) -> Column:
    """The Luhn test of a string of digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """The kinds' tests of a base match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (F.when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(9, 15)).otherwise(True))


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """A struct of kind, base and the pattern's matches in order, each with the length of the gap before it and its context."""
    seen = r"@|\(at\)|\[at\]" if kind == "email" else "[0-9]"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)

    told = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    placed = F.zip_with(told, F.slice(gaps, 2, 1 << 30), lambda x, after: F.struct(
        F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
        F.left(after, F.lit(CONTEXT)).alias("after")))
    matches = F.filter(placed, lambda x: x["match"].isNotNull())
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(text.rlike(seen), matches).alias("matches"))


def proposed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, print, groups): one row per row of `docs`, numbered, with all matches of all patterns; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    groups = [_matches(F.col("text"), k, p, True) for k, p in BASE.items()] + [_matches(F.col("text"), k, p, False) for k, p in LOOSE.items()]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return stored(rows.select("row", "doc_id", F.xxhash64("text").alias("print"), F.filter(F.array(*groups), lambda g: F.size(g["matches"]) > 0).alias("groups")), "proposed")


def _placed(rows: DataFrame) -> DataFrame:
    """(row, kind, base, start, end, match, before, after): base matches that pass their kind's test, and all candidates."""
    each = (rows.select("row", F.explode("groups").alias("g")).select("row", "g.kind", "g.base", F.posexplode("g.matches").alias("at", "m"))
            .select("row", "kind", "base", "at", "m.*"))
    so_far = Window.partitionBy("row", "kind", "base").orderBy("at")
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return (each.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("match")).cast("int"))
            .where(~F.col("base") | passes(F.col("kind"), F.col("match")))
            .select("row", "kind", "base", "start", "end", "match", "before", "after"))


def _touches(*keys: str) -> Column:
    """Whether a span overlaps a base span of the same `keys`: one that begins no later and reaches into it, or begins within it."""
    earlier = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))


def _features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    length, digits = F.length(match), F.regexp_count(match, F.lit("[0-9]"))

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    cue = reduce(lambda x, k: x.when(F.col("kind") == k, before.rlike(rf"(?i)(?:{CUES[k]})[^A-Za-z]*$")), KINDS, F.when(F.lit(False), False))
    features = {
        "length": length, "digits": digits, "digit_share": digits / length, "groups": F.regexp_count(match, F.lit("[0-9]+")),
        "longest_group": F.length(F.array_max(F.transform(F.regexp_extract_all(match, F.lit("([0-9]+)"), F.lit(1)), lambda g: F.regexp_replace(g, "[0-9]", "9")))),
        "dots": F.regexp_count(match, F.lit("[.]")), "dashes": F.regexp_count(match, F.lit("-")), "blanks": F.regexp_count(match, F.lit(" ")),
        "brackets": F.regexp_count(match, F.lit("[()]")), "plus": flag(match.startswith("+")), "at": flag(match.contains("@")),
        "letters": F.regexp_count(match, F.lit("[A-Za-z]")), "last_label": F.length(F.regexp_extract(match, r"[.]([A-Za-z]+)$", 1)),
        "letter_before": flag(before.rlike("[A-Za-z0-9]$")), "letter_after": flag(after.rlike("^[A-Za-z0-9]")),
        "blank_before": flag((before == "") | before.rlike(r"[\s(:,;<]$")), "blank_after": flag((after == "") | after.rlike(r"^[\s).,;:>!?]")),
        "sign_before": flag(before.rlike(r"[$#=/_\"'-]$")), "cue": flag(cue),
    } | {f"is_{k}": flag(F.col("kind") == k) for k in KINDS}
    return candidates.withColumns({f"f_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in features.items()}), [f"f_{n}" for n in features]


def _cut(scored: DataFrame, precision: float) -> float | None:
    """The lowest score from which on the share of true rows is at least `precision`; none if there is none. `scored` has truth and score.

    Rows are counted per score, scores put in order within `RANGES` ranges, and each range moved by what the ones above it hold, so no
    task sees more than a range's scores or the ranges' sums.
    """
    counts = (scored.groupBy("score").agg(F.sum("truth").alias("hits"), F.count(F.lit(1)).alias("n"))
              .withColumn("range", F.floor(F.col("score") * RANGES)))
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("range").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select(
        "range", F.coalesce(F.sum("hits").over(above), F.lit(0.0)).alias("hits_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"))
    so_far = counts.select("range", "score", F.sum("hits").over(inside).alias("hits"), F.sum("n").over(inside).alias("n")).join(totals, "range")
    share = (F.col("hits") + F.col("hits_above")) / (F.col("n") + F.col("n_above"))
    return so_far.where(share >= precision).agg(F.min("score")).first()[0]


def _selected(candidates: DataFrame, precision: float, trees: int, depth: int) -> DataFrame:
    """The candidates (with `truth`) whose score reaches the calibrated threshold; none if only one class is there to learn from."""
    known, names = _features(candidates)
    fold = F.pmod(F.xxhash64("match", "before", "after", "kind", "start", "row"), F.lit(2)) == 0
    known = stored(known.withColumn("learn", fold), "candidates")
    learn = known.where("learn").select("truth", *names)
    classes = learn.agg(F.min("truth"), F.max("truth")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return candidates.limit(0)
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(labelCol="truth", maxIter=trees, maxDepth=depth, maxBins=64, seed=7).fit(assemble.transform(learn))
    scored = stored(model.transform(assemble.transform(known)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
                    .select(*candidates.columns, "learn", "score"), "scored")
    cut = _cut(scored.where("NOT learn"), precision)
    if cut is None:
        return candidates.limit(0)
    return scored.where(F.col("score") >= cut).select(*candidates.columns)


def spans(rows: DataFrame, precision: float = PRECISION, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(row, kind, base, start, end, match) of all spans of `rows`, the result of `proposed`.

    Added spans do not overlap base spans. Of added spans of one text, one that begins before an earlier one's end is left out.
    Without both true and other candidates to learn from, only base spans come out.
    """
    placed = _placed(rows).withColumn("truth", _touches("row", "kind").cast("double")).withColumn("touches", _touches("row"))
    found = stored(placed, "spans")
    added = _selected(found.where("NOT base"), precision, trees, depth).where("NOT touches")
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    free = added.withColumn("reach", F.max("end").over(earlier)).where("reach IS NULL OR start >= reach")
    columns = ["row", "kind", "base", "start", "end", "match"]
    return found.where("base").select(*columns).union(free.select(*columns))


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs` (doc_id, text, any others, which are not read): doc_id, base span counts n_email, n_ip, n_card, n_phone,
    base_sha256 and spans: `kind:start:end` by kind as in `KINDS`, then start, comma-joined; the first of base spans and hashed.

    Null and empty texts have no spans; repeated rows each have their own; null ids stay.
    """
    rows = proposed(docs)
    place = reduce(lambda x, k: x.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), -1))
    per_row = spans(rows, **options).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base"))).alias("found"))

    def told(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = F.coalesce("found", F.array().cast("array<struct<place:int,start:int,end:int,kind:string,base:boolean>>"))
    base = F.filter(found, lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return (rows.select("row", "doc_id").join(per_row, "row", "left")
            .select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(found).alias("spans")))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text, with every span replaced by its kind in capitals and brackets; of overlapping spans the first stands."""
    rows = proposed(docs)
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = (spans(rows, **options).withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0))).where("start >= reach")
           .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")))
    known = rows.join(cut, "row").select(F.col("doc_id").alias("cut_id"), "print", "cuts").dropDuplicates(["cut_id", "print"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(known, texts.doc_id.eqNullSafe(known.cut_id) & (F.xxhash64(texts.text) == known.print), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    after = F.aggregate("cuts", start, lambda s, c: F.struct(
        F.concat(s["out"], F.substr("text", s["at"] + 1, c["start"] - s["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]")).alias("out"), c["end"].alias("at")))
    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(
        F.concat(after["out"], F.substr("text", after["at"] + 1, F.length("text")))).alias("text"))
