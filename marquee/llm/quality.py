"""Quality by hierarchical empirical Bayes: a document's own evidence, its host and its path within the host.

Evidence. A logistic model over counts taken from the whole text gives each document a probability of being good. Spark fits it
on all labelled documents; the counts are taken once and stored.

Sites. A host's share of good documents has a Beta prior with the mean of all documents; a path's has one with its host's
posterior as mean. Each prior's strength (how many documents it counts as) is estimated by moments from how much the groups
differ beyond what their sizes explain, so sparse hosts and paths shrink towards the level above them. All sums are
grouped aggregates over all documents. A document's posterior log-odds are its evidence plus what its path (without the document itself)
says beyond the overall mean. The threshold keeps the share `KEEP` of all labelled good documents.
"""

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_name, quoted, stored
from marquee.llm.toxicity import predict

KEEP = 0.99
#: Weight of the model's ridge penalty, as rows.
RIDGE = 1.0
#: How many measures there are, and how many deviations from the mean count.
MEASURES, FAR = 11, 8.0
#: A prior counts as at least and at most so many documents.
STRENGTH = (1.0, 1e6)

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SIGNS = b"#$%&*|~^_=+<>{}[]\\/@"
STOPS = b".!?"


def measures(text: str | None) -> list[float]:
    """Counts of a text, as shares and logarithms; all zero for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * MEASURES
    data, n = text.encode("utf-8", "surrogatepass"), len(words)

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / len(data)

    lines = [line for line in text.split("\n") if line.strip()]
    distinct = len(set(words)) / n
    return [np.log1p(n), min(np.log(1 + len(data) / n), 6.0), share(UPPER), share(DIGITS), share(SIGNS), share(b"!"), share(b"|"),
            share(STOPS), distinct, distinct * np.log1p(n), len(set(lines)) / len(lines)]


def evidence(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in measures(t)] for t in texts])

    return measured(text)


class Evidence:
    """A fitted model: features are centred and scaled, then weighed."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, model: np.ndarray):
        self.middle, self.scale, self.model = middle, scale, model

    def probability(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.middle) / self.scale, -FAR, FAR)
        return np.clip(predict(self.model, np.hstack([z, z ** 2])), 1e-6, 1 - 1e-6)


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of all documents whose labels agree."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most"))


def train(measured: DataFrame, known: DataFrame) -> Evidence | None:
    """The model, fitted on every row of `measured` (doc_id, measures) that `known` has a label for, an id's repeats once. None without
    labels of both classes."""
    rows = stored(measured.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("measures").alias("measures")), "labelled")
    good = (F.col("quality") == 1).cast("double")
    told = rows.agg(F.count(F.lit(1)), F.min(good), F.max(good), *[
        f(F.col("measures")[i]) for f in (F.avg, F.stddev_pop) for i in range(MEASURES)]).first()
    if told[1] is None or told[1] == told[2]:
        return None
    middle, scale = np.array(told[3:3 + MEASURES]), np.array(told[3 + MEASURES:]) + 1e-9

    def fixed(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    z = F.transform(F.arrays_zip(F.col("measures").alias("x"), fixed(middle).alias("m"), fixed(scale).alias("s")),
                    lambda v: F.least(F.greatest((v["x"] - v["m"]) / v["s"], F.lit(-FAR)), F.lit(FAR)))
    features = rows.select(good.alias("label"), z.alias("z")).select(
        "label", array_to_vector(F.concat("z", F.transform("z", lambda x: x * x))).alias("features"))
    fitted = LogisticRegression(maxIter=100, regParam=RIDGE / told[0], standardization=False, tol=1e-9).fit(features)
    return Evidence(middle, scale, np.append(fitted.coefficients.toArray(), fitted.intercept))


def strength(groups: DataFrame, mean: Column) -> float:
    """How many documents a prior counts as, by moments: `groups` has n and total (of probabilities) per group, `mean` the prior's mean.
    Groups of equal shares make a strong prior, groups that differ a weak one."""
    rate = F.col("total") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (rate - mean) ** 2).alias("apart"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
                     F.sum(F.col("n") * mean * (1 - mean)).alias("spread")).first()
    if not row["n"] or row["groups"] < 2 or not row["spread"]:
        return STRENGTH[1]
    within = row["spread"] / row["n"]
    between = row["apart"] / row["n"] - within * row["groups"] / row["n"]
    return float(np.clip(within / between - 1, *STRENGTH)) if between > 0 else STRENGTH[1]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, total, host_posterior) per path of `scored` (host, path, p); the overall mean; both strengths."""
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = hosts.agg(F.sum("n"), F.sum("total")).first()
    mean = float(np.clip(whole[1] / whole[0], 1e-6, 1 - 1e-6)) if whole[0] else 0.5
    of_host = strength(hosts, F.lit(mean))
    known = hosts.select(F.col("host").alias("of"), ((F.col("total") + of_host * mean) / (F.col("n") + of_host)).alias("host_posterior"))
    with_host = paths.join(known, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return with_host, mean, of_host, strength(with_host, F.col("host_posterior"))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP) -> DataFrame:
    """One row per row of `docs`: doc_id, evidence, host_posterior, path_posterior, posterior and keep.

    Null hosts and paths are groups of their own; null and empty texts have the evidence the model gives to no words; repeated rows
    count as often as they come; null ids stay. Without labels of both classes every evidence is one half and everything is kept.
    """
    known = agreed(labels)
    rows = stored(docs.select("doc_id", quoted(host).cast("string").alias("host"), quoted(path).cast("string").alias("path"),
                              evidence(F.col("text")).alias("measures")), "measured")
    model = train(rows.select("doc_id", "measures"), known)

    @F.pandas_udf("double")
    def probability(values: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(values.to_list())) if len(values) else [], dtype=float)

    p = probability(F.col("measures")) if model else F.lit(0.5)
    scored = stored(rows.select("doc_id", "host", "path", p.alias("p")), "scored")
    sites, mean, _, of_path = site_posteriors(scored)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "total", "host_posterior")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    others = (F.col("total") - F.col("p") + of_path * F.col("host_posterior")) / (F.col("n") - 1 + of_path)

    def odds(x: Column) -> Column:
        return F.log(x / (1 - x))

    safe = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    together = odds(F.col("p")) + odds(safe) - odds(F.lit(mean))
    out = joined.select("doc_id", F.col("p").alias("evidence"), "host_posterior", safe.alias("path_posterior"),
                        (1 / (1 + F.exp(-together))).alias("posterior"))
    cut = 0.0
    if model:
        good = out.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
        cut = good.agg(F.percentile_approx("posterior", 1 - keep, 100_000)).first()[0] or 0.0
    return out.withColumn("keep", F.col("posterior") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows and columns of `docs` whose doc_id is kept; rows without doc_id stay."""
    dropped = posteriors(docs, labels, **options).where("NOT keep AND doc_id IS NOT NULL").select("doc_id").distinct()
    mark = free_name(docs, "dropped_id")
    return docs.join(dropped.select(F.col("doc_id").alias(mark)), F.col("doc_id") == quoted(mark), "left_anti")
