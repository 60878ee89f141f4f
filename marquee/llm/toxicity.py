"""Toxicity by a classifier chain of linear models.

Features are the words of the lower-cased text, whole and by their first `STEMS` letters, so that inflected and compounded
forms count for their stem; a feature's value is the logarithm of one more than its occurrences, those over `MANY` counted as
that many. The chain predicts one category after the other. Each model
sees the features and the log-odds that the models before it gave. So that later models learn from the kind of
predictions they will get, earlier ones are predicted out of fold while training: every training row's probability comes
from a model that has not seen the row. Each category's threshold is calibrated on its out-of-fold probabilities.

Fitting. At most `ROWS` rows of each class, those with the smallest hash of doc_id, are the training sample; class weights give
back the labelled shares. `FEATURES` features are kept, those most unevenly spread between the classes of some category, counted
by Spark over the sample. The driver sees a matrix of at most 2 * ROWS by FEATURES. Scoring reads every text whole; nothing is shuffled.
"""

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_name, per_process, quoted, stored

ROWS = 3000
FEATURES = 240
STEMS = (4, 5, 6)
FOLDS = 3
#: Precision a threshold must have out of fold, and the least threshold: with few labels a lower one would say nothing.
PRECISION, LEAST = 0.8, 0.3
#: Occurrences of a feature in one text beyond which more say nothing more.
MANY = 8
RIDGE = 0.5
#: Words whose features a worker remembers.
REMEMBERED = 200_000
EDGES = ".,;:!?\"'()[]{}<>«»“”„…*-–—"


def word_features(word: str) -> list[int]:
    bare = word.strip(EDGES)
    if not bare:
        return []
    digest = xxhash.xxh64_intdigest
    return [digest(p, seed) & 0x7FFFFFFFFFFFFFFF for p, seed in [(bare, 0), *((bare[:n], n) for n in STEMS if len(bare) >= n)]]


def text_features(text: str | None) -> Counter:
    """How often a text holds each feature."""
    out = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        for f in word_features(word):
            out[f] += n
    return out


class Chain:
    """The fitted models: for each category the feature weights, bias, weights of earlier log-odds, and threshold."""

    def __init__(self, categories: list[str], features: list[int]):
        self.categories, self.features = categories, features
        self.models: list[np.ndarray] = []
        self.thresholds: list[float] = []

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        odds = np.empty((len(values), 0))
        for model in self.models:
            odds = np.hstack([odds, logit(predict(model, np.hstack([values, odds])))[:, None]])
        return 1 / (1 + np.exp(-odds))

    def place(self) -> dict[int, int]:
        return {f: i for i, f in enumerate(self.features)}


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def predict(model: np.ndarray, values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values @ model[:-1] + model[-1], -30, 30)))


def fit_linear(values: np.ndarray, truth: np.ndarray, weights: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Logistic regression with a ridge penalty (none on the bias, which comes last), by Newton steps."""
    design = np.hstack([values, np.ones((len(values), 1))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    model = np.zeros(design.shape[1])
    for _ in range(steps):
        p = predict(model, values)
        slope = design.T @ (weights * (p - truth)) + penalty * model
        curve = (design * (weights * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        model -= move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-4:
            break
    return model


def calibrate(p: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> float:
    """The cut of best F1 over the weighted rows among those of at least `PRECISION`, half way to the next probability below and at
    least `LEAST`; above one, so that nothing is rejected, if no cut is that precise."""
    if not truth.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, hit, w = p[order], truth[order] * weights[order], weights[order]
    hits, seen = np.cumsum(hit), np.cumsum(w)
    f1 = np.where(hits / seen >= PRECISION, 2 * hits / (seen + hits[-1]), -1)
    f1[:-1][p[:-1] == p[1:]] = -1  # rows of one probability are not cut apart
    best = int(f1.argmax())
    if f1[best] < 0:
        return 2.0
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return max(LEAST, float(1 / (1 + math.exp(-(logit(p[best:best + 1])[0] + logit(np.array([below]))[0]) / 2))))


def fit_chain(values: np.ndarray, truths: np.ndarray, weights: np.ndarray, categories: list[str], features: list[int],
              folds: int = FOLDS) -> Chain:
    out = Chain(categories, features)
    fold = np.arange(len(values)) % folds
    odds = np.empty((len(values), 0))
    for k in range(len(categories)):
        seen, truth = np.hstack([values, odds]), truths[:, k].astype(float)
        held_out = np.zeros(len(values))
        for f in range(folds):
            mine = fold == f
            held_out[mine] = predict(fit_linear(seen[~mine], truth[~mine], weights[~mine]), seen[mine])
        out.models.append(fit_linear(seen, truth, weights))
        out.thresholds.append(calibrate(held_out, truth, weights))
        odds = np.hstack([odds, logit(held_out)[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = ROWS, features: int = FEATURES) -> Chain | None:
    """The chain fitted on a sample of `labels` (doc_id, one 0/1 column per category, the first the broadest). None if the labels do
    not show both classes of the first category. Labels that are null, without a document or contradict each other are left out."""
    clean = (labels.where(F.col("doc_id").isNotNull()).dropna(subset=categories).groupBy("doc_id")
             .agg(*[F.max(c).alias(c) for c in categories], F.sum(F.lit(1)).alias("n"),
                  *[F.min(c).alias(f"least_{i}") for i, c in enumerate(categories)])
             .where(" AND ".join(f"`{c}` = least_{i}" for i, c in enumerate(categories))).select("doc_id", *categories))
    shares = {r[0]: r[1] for r in clean.groupBy(categories[0]).count().collect()}
    if not {0, 1} <= set(shares):
        return None
    turned = clean.withColumn("turn", F.xxhash64("doc_id"))
    # a sorted limit per class keeps `rows` in every task, before anything is shuffled
    drawn = reduce(DataFrame.union, [turned.where(F.col(categories[0]) == c).orderBy("turn", "doc_id").limit(rows) for c in sorted(shares)])
    sample = stored(docs.select(F.col("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # at most 2 * rows ids
                    .groupBy("doc_id", "turn", *categories).agg(F.min("text").alias("text")), "labelled")

    @F.pandas_udf("array<long>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(text_features(t)) for t in texts])

    spread = sample.select(*categories, F.explode(held("text")).alias("feature"))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = stored(spread.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])
                    .where("n > 2"), "spread")
    kept: dict[int, None] = {}
    for c in categories:
        positive = max(1, totals[c] or 0)
        negative = max(1, totals["n"] - positive)
        yes, no = F.col(c) / positive, (F.col("n") - F.col(c)) / negative
        uneven = (yes - no) / F.sqrt(yes * (1 - yes) / positive + no * (1 - no) / negative + 1.0 / totals["n"] ** 2)
        best = counts.orderBy(F.desc(uneven), "feature").limit(features // len(categories)).select("feature")
        kept |= dict.fromkeys(r[0] for r in best.collect())
    names = list(kept)
    place = {f: i for i, f in enumerate(names)}

    @F.pandas_udf("map<int,long>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([{place[f]: n for f, n in text_features(t).items() if f in place} for t in texts])

    found = sample.select("doc_id", "turn", *categories, places("text").alias("at")).collect()
    found.sort(key=lambda r: (r["turn"], r["doc_id"]))
    seen, order = Counter(), {}
    for r in found:  # the first of each class, then the second of each
        order[r["doc_id"]] = seen[r[categories[0]]]
        seen[r[categories[0]]] += 1
    found.sort(key=lambda r: (order[r["doc_id"]], r["doc_id"]))
    values = np.zeros((len(found), len(names)))
    for i, r in enumerate(found):
        values[i, list(r["at"])] = list(r["at"].values())
    values = np.log1p(np.minimum(values, MANY))
    truths = np.array([[r[c] for c in categories] for r in found]).reshape(len(found), len(categories))
    drawn_of = {v: max(1, int((truths[:, 0] == v).sum())) for v in (0, 1)}
    weights = np.array([shares[t] / drawn_of[t] for t in truths[:, 0]])
    weights /= weights.min()
    return fit_chain(values, truths, weights, categories, names)


def probabilities(text: Column, model: Chain) -> Column:
    """An array of the chain's probabilities, in its order."""
    place = model.place()

    @F.pandas_udf("array<double>")
    def scored(texts: pd.Series) -> pd.Series:
        known = per_process(("toxic words", hash(tuple(model.features))), dict)
        out = []
        for at in range(0, len(texts), 512):
            some = texts.iloc[at:at + 512]
            values = np.zeros((len(some), len(place)))
            for i, text in enumerate(some):
                for word, n in Counter((text or "").lower().split()).items():
                    columns = known.get(word)
                    if columns is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        columns = known[word] = tuple(place[f] for f in word_features(word) if f in place)
                    if columns:
                        values[i, list(columns)] += n
            out += model.probabilities(np.log1p(np.minimum(values, MANY))).tolist()
        return pd.Series(out, index=texts.index)

    return scored(text)


def by_language(docs: DataFrame, labels: DataFrame, most: int = 6) -> tuple[DataFrame, list[str]]:
    """The chain's categories from one toxic label: toxic at all, then toxic in each of the languages with most toxic labels
    (at most `most`), then toxic in any other language if there are more. Columns doc_id and the categories."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .join(docs.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id"))
    found = [r[0] for r in known.where("toxic = 1 AND lang IS NOT NULL").groupBy("lang").count()
             .orderBy(F.desc("count"), "lang").limit(most + 1).collect()]
    langs = found[:most]
    columns = {f"toxic_{i}": F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1) & F.col("lang").eqNullSafe(F.lit(lang)))
               for i, lang in enumerate(langs)}
    if len(found) > most:
        columns["toxic_other"] = F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1) & F.coalesce(~F.col("lang").isin(langs), F.lit(False)))
    return (known.select("doc_id", F.col("toxic"), *[c.cast("int").alias(n) for n, c in columns.items()]),
            ["toxic", *columns])


def judged(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """`docs` with a struct `column`: the chain's probabilities by category, the strongest category, and rejected.

    A row is rejected if a category reaches its threshold. Null and empty texts have no features and get the models' bias. Without labels
    of both classes nothing is rejected and there are no probabilities. Repeated rows and null ids stay; extra columns too.
    """
    known, categories = by_language(docs, labels)
    model = train(docs, known, categories)
    names = categories if model else []
    p = free_name(docs, "p")
    out = docs.withColumn(p, probabilities(F.col("text"), model) if model else F.array().cast("array<double>"))
    over = [F.get(quoted(p), F.lit(i)) >= t for i, t in enumerate(model.thresholds if model else [])]
    rejected = F.lit(False)
    for o in over:
        rejected = rejected | F.coalesce(o, F.lit(False))
    fields = [F.get(quoted(p), F.lit(i)).alias(n) for i, n in enumerate(names)]
    return out.withColumn(column, F.struct(*fields, F.array_max(quoted(p)).alias("strongest"), rejected.alias("rejected"))).drop(p)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, toxicity (the highest probability of the chain) and rejected."""
    mark = free_name(docs, "verdict")
    verdict = quoted(mark)
    return judged(docs, labels, mark).select("doc_id", verdict["strongest"].alias("toxicity"), verdict["rejected"].alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of `docs` that are not rejected."""
    mark = free_name(docs, "verdict")
    return judged(docs, labels, mark).where(~quoted(mark)["rejected"]).drop(mark)
