"""Scored evaluations of labels and of retrieval."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOORS = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55)


def _scores() -> list[Column]:
    return [F.count("*").alias("n_total"), F.count("label").alias("n_labelled"),
            F.count_if(F.coalesce(F.col("label") == F.col("expected"), F.lit(False))).alias("n_right")]


def _shares(df: DataFrame) -> DataFrame:
    def share(a, b):
        return F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)

    return df.withColumns({"coverage": share("n_labelled", "n_total"), "precision": share("n_right", "n_labelled"),
                           "correct": share("n_right", "n_total")})


def _labelled(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Every item with an expected label, with what was predicted for it."""
    return gold.where(F.col("expected").isNotNull()).join(pred, "id", "left")


def score_labels(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Coverage, precision and share correct; `pred` has (id, label), `gold` (id, expected)."""
    return _shares(_labelled(pred, gold).agg(*_scores()))


def sweep_floor(scored: DataFrame, gold: DataFrame, floors=FLOORS) -> DataFrame:
    """Scores of the similarity guess alone and behind the rules, at every floor; the best hybrid floor is marked.

    `scored` has (id, ruled, guess, similarity). One pass: each item fans out to the floors and is counted map-side.
    """
    rows = _labelled(scored, gold).withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors])))
    guess = F.when(F.col("similarity") >= F.col("floor"), F.col("guess"))
    tried = rows.select("floor", "expected", F.inline(F.array(
        F.struct(F.lit("semantic").alias("strategy"), guess.alias("label")),
        F.struct(F.lit("hybrid").alias("strategy"), F.coalesce(F.col("ruled"), guess).alias("label")))))
    table = _shares(tried.groupBy("strategy", "floor").agg(*_scores()))
    best = table.where(F.col("strategy") == "hybrid").agg(
        F.max_by("floor", F.struct(F.col("correct"), -F.col("floor"))).alias("f")).scalar()
    return table.withColumn("best", (F.col("strategy") == "hybrid") & (F.col("floor") == best))


def label_errors(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """What was labelled wrongly and what was declined."""
    rows = _labelled(pred, gold)
    return rows.where(F.col("label").isNull() | (F.col("label") != F.col("expected"))).withColumn(
        "error", F.when(F.col("label").isNull(), "declined").otherwise("wrong"))


def judge_retrieval(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Pass or fail per request. `results` are its top rows (query_id, name, category, neighborhood); `expectations`
    has (query_id, must, must_not, min_results)."""
    rows = expectations.join(results, "query_id", "left")
    title = F.lower(F.concat_ws(" ", F.col("name"), F.coalesce("category", F.lit(""))))
    full = F.concat_ws(" ", title, F.lower(F.coalesce("neighborhood", F.lit(""))))

    def names(text, words):
        return F.coalesce(F.col("name").isNotNull() & F.exists(words, lambda w: text.contains(F.lower(w))), F.lit(False))

    judged = rows.groupBy("query_id", "min_results", F.size("must").alias("wanted")).agg(
        F.count("name").alias("results"), F.max(names(title, "must_not")).alias("forbidden"),
        F.max(names(full, "must")).alias("matched"))
    reason = (F.when(F.col("results") < F.col("min_results"), "too few results")
              .when(F.col("results") == 0, "nothing expected, nothing found")
              .when(F.col("forbidden"), "forbidden word").when(F.col("wanted") == 0, "no word required")
              .when(F.col("matched"), "matched").otherwise("no result matched"))
    return judged.withColumn("reason", reason).withColumn(
        "passed", F.col("reason").isin("nothing expected, nothing found", "no word required", "matched"))


def retrieval_pass_rate(judged: DataFrame) -> DataFrame:
    out = judged.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return out.withColumn("percent", F.expr("coalesce(try_divide(100 * passed, total), 0)").cast("bigint"))
