"""Toxicity by cumulative-link ordinal regression over sparse text features.

``P(grade > k) = sigmoid(w . x - threshold_k)``: one weight per feature for all thresholds, which rise. The
features are log(1 + count) of the words, and of the beginnings of words (``PREFIXES`` letters), that occur
significantly more often in documents labelled toxic. They have to be significant over all texts, and also where a
word counts only in a text that is the only one, or taken as the only one, to have it after some words and before
some words: near copies of a text count once.
Labels say only whether a document is toxic, so the grades above 0 are an assumption: grade 0 is clean; toxic ones
have grade 1, 2 or 3 by the third of the toxic documents that their number of such features falls in (1 without any).
The model is fitted on at most ``max_rows`` distinct labelled texts, by smallest hash of the id; every document is
then scored whole.

Defined results: a null or empty text has no features, hence the severity of a text without such words;
labels that are null are not used, of several labels of an id the highest counts; without toxic labels
nothing is toxic; rows that repeat are each scored; ids may be null. Other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

GRADES = 4
#: The bound on the training sample, and on the features.
MAX_ROWS, MAX_FEATURES = 20_000, 2_000
#: Least likelihood ratio (G squared) of a feature word, and of a beginning, which stands for many words.
LEAST_G2, LEAST_G2_BEGINNING = 16.0, 32.0
#: So many words before it, and so many after it, make a word's places.
BESIDE = 5
REJECT = 0.5
#: Beginnings of words that are features too, if the word is longer.
PREFIXES = (3, 5, 7)
#: Words whose features a worker remembers.
REMEMBERED = 300_000
TERM = r"\p{L}+"
_term = re.compile(r"[^\W\d_]+")


class Features(dict):
    """word -> its features that have a weight."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(f for f in (word, *("^" + word[:k] for k in PREFIXES if len(word) > k)) if f in self.weights)
        return found


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def all_above(self, texts: Iterable[str | None]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ... of each text."""
        features, scores = Features(self.weights), []
        for text in texts:
            counts: dict[str, int] = {}
            for found in filter(None, map(features.__getitem__, _term.findall((text or "").lower()))):
                for f in found:
                    counts[f] = counts.get(f, 0) + 1
            scores.append(sum(self.weights[f] * math.log1p(n) for f, n in counts.items()))
        return 1 / (1 + np.exp(np.array(self.thresholds)[None] - np.array(scores, float).reshape(-1, 1)))

    def above(self, text: str | None) -> np.ndarray:
        return self.all_above([text])[0]


class Sparse:
    """A matrix of few values, for products with vectors."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @property
    def T(self) -> "Sparse":
        return Sparse(self.column, self.row, self.value, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.shape[0])


def _negative(theta: np.ndarray, x: np.ndarray | Sparse, y: np.ndarray, n: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and its gradient; theta: first threshold, log steps, weights."""
    k = GRADES - 1
    cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:k]))])
    w = theta[k:]
    eta = x @ w
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(over="ignore"):
        high, low = 1 / (1 + np.exp(eta - edges[y + 1])), 1 / (1 + np.exp(eta - edges[y]))
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high), low * (1 - low)
    g_eta = n * (d_high - d_low) / p
    g_cut = np.zeros(k)
    for j in range(k):
        g_cut[j] = -(n * d_high / p)[y == j].sum() + (n * d_low / p)[y == j + 1].sum()
    g = np.empty_like(theta)
    g[0] = g_cut.sum()
    for j in range(1, k):
        g[j] = np.exp(theta[j]) * g_cut[j:].sum()
    g[k:] = x.T @ g_eta + ridge * w
    return float(-(n * np.log(p)).sum() + ridge * (w @ w) / 2), g


def fit_rows(x: np.ndarray | Sparse, y: np.ndarray, n: np.ndarray, steps: int = 1500, ridge: float = 0.02) -> np.ndarray:
    """Maximum penalised likelihood by full-batch gradient steps with momentum (Adam); n: weights of rows."""
    theta = np.zeros(GRADES - 1 + x.shape[1])
    theta[0] = 2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, g = _negative(theta, x, y, n / n.sum(), ridge / n.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    # bounded by max_rows, hence broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    terms = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # copies of a text count once
    texts = stored(rows.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text_hash", "toxic", terms.alias("terms")), "labelled")
    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = totals["n"], totals["bad"]
    if not bad or bad == n:
        return Model({}, [50.0] * (GRADES - 1))

    def significant(pairs: DataFrame) -> list[str]:
        """From w, toxic of every text that a feature is in; a beginning that is in no other texts than one of its
        words, or than a longer beginning, says nothing new."""
        words = pairs.groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("t")).where("a > 1")
        a, t = F.col("a").cast("double"), F.col("t").cast("double")
        log0 = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        g2 = 2 * (log0(a, t * (bad / n)) + log0(t - a, t * (1 - bad / n)) + log0(bad - a, (n - t) * (bad / n)) + log0((n - t) - (bad - a), (n - t) * (1 - bad / n)))
        least = F.when(F.startswith("w", F.lit("^")), LEAST_G2_BEGINNING).otherwise(LEAST_G2)
        chosen = words.withColumn("g2", g2).where((F.col("g2") >= least) & (a / t > bad / n))
        kept, covered = [], set()
        for r in sorted(chosen.orderBy(F.desc("g2"), "w").limit(MAX_FEATURES).collect(), key=lambda r: (r["w"][0] == "^", -len(r["w"]), r["w"])):
            word = r["w"].removeprefix("^")
            if word == r["w"] or (word, r["t"]) not in covered:
                kept.append(r["w"])
                covered |= {(word[:k], r["t"]) for k in PREFIXES if len(word) > k}
        return kept

    def features_of(word: Column) -> Column:
        return F.array_compact(F.array(word, *[F.when(F.length(word) > k, F.concat(F.lit("^"), F.left(word, F.lit(k)))) for k in PREFIXES]))

    listed = lambda words: F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in words], "w string"))
    in_text = F.array_distinct(F.flatten(F.transform(F.array_distinct("terms"), features_of)))
    first = significant(texts.select("toxic", F.explode(in_text).alias("w")))
    # The BESIDE words before a word, and those after it, are its places (at the ends of a text, as
    # many words on both sides). One that several texts have is that of one of them, a toxic one if there is one:
    # toxic texts have negative numbers.
    number = F.shiftrightunsigned("text_hash", 1).bitwiseOR(F.when(F.col("toxic") > 0, F.lit(-(2**63))).otherwise(F.lit(0)))
    def around(i: Column, start: Column) -> Column:
        """The BESIDE words beside word i from ``start`` on."""
        start = F.greatest(start, F.lit(1))
        return F.xxhash64(F.slice("terms", start, i - start), F.slice("terms", i + 1, start + BESIDE - i))

    places_of = F.transform("terms", lambda w, i: F.struct(w.alias("w"), F.array(around(i + 1, i + 1 - BESIDE), around(i + 1, F.least(i + 1, F.size("terms") - BESIDE))).alias("places")))
    places = texts.select(number.alias("number"), F.explode(places_of).alias("at")).select("number", F.explode(features_of(F.col("at.w"))).alias("w"), "at.places").join(listed(first), "w")
    owned = places.select("number", "w", F.posexplode("places").alias("side", "place")).groupBy("w", "side", "place").agg(F.min("number").alias("number"))
    own = owned.groupBy("w", "number").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low < high")
    vocabulary = significant(own.select("w", (F.col("number") < 0).cast("int").alias("toxic")))
    if not vocabulary:
        return Model({}, [50.0] * (GRADES - 1))
    # only the counts of features in at most max_rows texts come to the driver, equal ones once, and one count of the rest
    numbers = F.broadcast(docs.sparkSession.createDataFrame([*enumerate(vocabulary)], "id int, w string"))
    each = texts.select("text_hash", "toxic", F.explode("terms").alias("w")).select("text_hash", "toxic", F.explode(features_of(F.col("w"))).alias("w"))
    counts = each.join(numbers, "w").groupBy("text_hash", "toxic", "id").agg(F.count("*").cast("int").alias("n"))
    rows = counts.groupBy("text_hash", "toxic").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("cells"))
    rows = rows.groupBy("toxic", "cells").agg(F.count("*").alias("texts")).orderBy("toxic", "cells")
    held = rows.select("toxic", "texts", F.col("cells.id").alias("id"), F.col("cells.n").alias("n")).toArrow().combine_chunks()
    column = lambda name: held[name].combine_chunks()
    toxic, many = (np.asarray(column(c)).astype(int) for c in ("toxic", "texts"))
    all_of = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = [all_of.get(k, 0) - int(many[toxic == k].sum()) for k in (0, 1)]
    row = np.repeat(np.arange(len(toxic)), np.asarray(column("id").value_lengths()))
    counts = np.asarray(column("n").flatten()).astype(float)
    number = np.bincount(row, counts, len(toxic))
    x = Sparse(row, np.asarray(column("id").flatten()).astype(int), np.log1p(counts), (len(toxic) + 2, len(vocabulary)))
    cuts = np.quantile(np.repeat(number, many)[np.repeat(toxic, many) == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else [1, 1]
    y = np.concatenate([np.where(toxic == 1, 1 + (number > cuts[0]).astype(int) + (number > cuts[1]).astype(int), 0), [0, 1]]).astype(int)
    weight = np.concatenate([many, empty]).astype(float)
    theta = fit_rows(x, y, weight)
    k = GRADES - 1
    cut = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:k]))])
    return Model(dict(zip(vocabulary, theta[k:].tolist())), cut.tolist())


def severity(model: Model, text: Column) -> Column:
    """struct(p_toxic, severity, grade): P(grade > 0), the expected grade, and the most likely grade."""

    @F.pandas_udf("p_toxic double, severity double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            above = model.all_above(texts)
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(1), "grade": each.argmax(1).astype("int32")})

    return score(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, severity (the expected grade), grade, rejected of every row. Grades above 0 are ordered by an
    assumption, see above."""
    s = docs.select("doc_id", severity(fit(docs, labels), F.col("text")).alias("s")).select("doc_id", "s.*")
    return s.withColumn("rejected", F.col("p_toxic") >= REJECT)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    model = fit(docs, labels)
    # the row travels whole, so that its columns may have any names
    return docs.select(F.struct("*").alias("row"), severity(model, F.col("text")).alias("s")).where(F.col("s.p_toxic") < REJECT).select("row.*")
