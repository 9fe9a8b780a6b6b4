"""Operator 1, a quality classifier with Naive Bayes support vectors.

Indicators of token n-grams are scaled by the log of the ratio of their smoothed shares in the two classes, counted over
all labelled rows; a linear model with hinge loss is then fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, known_labels, release, small, small_batches, table, type_of
from turnstone.llm.textbatch import CLASSES, U64, WORD, mix, slices, span_hashes, tokens

#: Hashed dimensions of the n-grams; labelled rows of the fit, a bounded sample by hash of doc_id.
BITS, FIT_ROWS = 18, 3000
#: Tokens of an n-gram of tokens, and of one of their shapes.
NGRAM, SHAPES = 2, 4
#: Smoothing of the class counts, penalty of the hinge loss, passes over the sample.
ALPHA, COST, PASSES = 1.0, 1.0, 12
#: Share of the labelled good documents that the threshold may reject.
LOST = 0.002


class Model(NamedTuple):
    """weight: what each indicator adds to the score, ratio and coefficient together."""

    weight: np.ndarray
    bias: float
    threshold: float
    bits: int


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A token's shape: a word is in lower or upper case, a capital, capitalised or has digits; signs are their own."""
    def inside(held):
        sums = np.concatenate([[0], np.cumsum(held)])
        return sums[ends] - sums[starts]

    upper, digit = inside((data >= 65) & (data <= 90)), inside((data >= 48) & (data <= 57))
    lower = (ends - starts) - upper - digit
    kind = np.select([digit > 0, (upper > 1) & (lower == 0), (upper > 0) & (lower > 0), upper == 1], [5, 4, 3, 2], 1).astype(U64)
    return np.where(CLASSES[data[starts]] == WORD, mix(kind), words)


def indicators(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document): the distinct hashed n-grams of tokens and of their shapes of each document, documents in order."""
    starts, ends, doc = tokens(data, at)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = span_hashes(data, starts, ends)
    grams, owner = [], []
    for salt, base, longest in ((0, words, NGRAM), (100, _shapes(data, starts, ends, words), SHAPES)):
        for n in range(1, longest + 1):
            count = len(base) - n + 1
            if count > 0:
                h = np.full(count, salt + n, U64)
                for k in range(n):
                    h = h * U64(0x9FB21C651E98DF25) + base[k : count + k]
                same = doc[n - 1 :] == doc[:count]
                grams.append(mix(h)[same])
                owner.append(doc[:count][same])
    both = (np.concatenate(owner).astype(np.int64) << bits) | (np.concatenate(grams) >> U64(64 - bits)).astype(np.int64)
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both & ((1 << bits) - 1), both >> bits


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, text), one line a labelled document: a null label is none, of several the largest counts."""
    return docs.select("doc_id", "text").filter("text is not null").join(small(known_labels(docs, labels)), "doc_id")


def _counts(batches, bits: int):
    """(quality, text) to (feature, good, bad): documents with the feature, one line a feature and task; feature -1 counts all."""
    tally, rows = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
    for part, data, at in slices(batches):
        good = part.column("quality").to_numpy(zero_copy_only=False) > 0
        feature, doc = indicators(data, at, bits)
        for k, held in ((0, good[doc]), (1, ~good[doc])):
            tally[k] += np.bincount(feature[held], minlength=1 << bits)
        rows += [good.sum(), (~good).sum()]
    used = np.flatnonzero(tally.sum(0))
    out = np.append(used, -1)
    yield pa.record_batch([pa.array(out), pa.array(np.append(tally[0, used], rows[0])), pa.array(np.append(tally[1, used], rows[1]))], names=["feature", "good", "bad"])


def _rows(batches, bits: int):
    """(quality, text) to (quality, features)."""
    for part, data, at in slices(batches):
        feature, doc = indicators(data, at, bits)
        ends = np.cumsum(np.bincount(doc, minlength=part.num_rows))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(feature.astype(np.int32)))
        yield pa.record_batch([part.column("quality"), lists], names=["quality", "features"])


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, cost: float, passes: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: min |w|^2 / 2 + sum of c_i max(0, 1 - y_i (w x_i + b)).

    A row's x is the ratio at its features and a constant 1; each class has the same total cost.
    """
    w, b = np.zeros(len(ratio)), 0.0
    alpha, order = np.zeros(len(rows)), np.arange(len(rows))
    values = [ratio[f] for f in rows]
    # rows are scaled to unit length, so that a long document is one vote like a short one
    values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
    norm = np.array([v @ v + 1.0 for v in values])
    upper = np.where(sign > 0, len(rows) / max(2 * (sign > 0).sum(), 1), len(rows) / max(2 * (sign < 0).sum(), 1)) * cost
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def _scores(batches, model: Model, carry: list[str]):
    """Adds score to the carried columns: w x + b with x of unit length, null for a null text."""
    scaled, squares = model.weight[0], model.weight[1]
    for part, data, at in slices(batches):
        n = part.num_rows
        feature, doc = indicators(data, at, model.bits)
        top = np.bincount(doc, scaled[feature], minlength=n)
        length = np.sqrt(np.bincount(doc, squares[feature], minlength=n))
        score = top / np.maximum(length, 1e-12) + model.bias
        null = part.column("text").is_null().to_numpy(zero_copy_only=False)
        yield pa.record_batch([*[part.column(c) for c in carry], pa.array(score, mask=null)], names=[*carry, "score"])


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS, lost: float = LOST) -> Model:
    """Ratios from all labelled rows, coefficients from at most fit_rows of them, the threshold from all of them.

    The driver gets 2^bits counts, fit_rows lists of features and a histogram of scores; none grows with the data.
    With only one class, or no labels, the model scores everything 0 and keeps it.
    """
    small_batches(docs.sparkSession)
    rows = cut(_labelled(docs, labels))
    counted = rows.select("quality", "text").mapInArrow(lambda it: _counts(it, bits), "feature long, good long, bad long")
    found = counted.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
    total = found[found.feature == -1]
    goods, bads = (int(total[c].iloc[0]) if len(total) else 0 for c in ("good", "bad"))
    if not goods or not bads:
        release(rows)
        return Model(np.zeros((2, 1 << bits)), 0.0, -1.0, bits)
    found = found[found.feature >= 0]
    tally = np.full((2, 1 << bits), ALPHA)
    tally[0, found.feature] += found.good
    tally[1, found.feature] += found.bad
    ratio = np.log(tally[0] / (goods + 2 * ALPHA)) - np.log(tally[1] / (bads + 2 * ALPHA))
    share = min(1.0, 1.2 * fit_rows / (goods + bads))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(fit_rows)
    fit = sample.select("quality", "text").mapInArrow(lambda it: _rows(it, bits), "quality int, features array<int>").toPandas()
    features = [np.asarray(f, np.int64) for f in fit.features]
    w, b = descend(features, np.where(fit.quality > 0, 1.0, -1.0), ratio, COST, PASSES)
    model = Model(np.stack([w * ratio, ratio * ratio]), b, 0.0, bits)
    held = rows.filter("quality > 0").select("text").mapInArrow(lambda it: _scores(it, model, []), "score double").groupBy(F.floor(F.col("score") * 1000).alias("at")).count().toPandas().sort_values("at")
    release(rows)
    below = held["count"].cumsum() - held["count"]
    ok = held[below <= lost * held["count"].sum()]
    return model._replace(threshold=min(0.0, float(ok["at"].iloc[-1]) / 1000))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, score, keep) for every row of docs: keep is score >= threshold.

    The threshold is 0, or lower, where more than LOST of the labelled good documents score below 0. A null text has no
    score and is not kept; an empty one has no indicators and scores the bias. doc_id may be of any type; the labels' doc_ids
    are taken as of the same, and those that can't be so count for nothing. Null doc_ids are scored like others and
    never labelled; repeated rows score the same. Labels of no document, and null labels, count for nothing. Other
    columns of either table are ignored; no rows give no rows. Whole texts count, of any length.
    """
    model = train(docs, labels, **parameters)
    scored = docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, model, ["doc_id"]), f"doc_id {type_of(docs, 'doc_id')}, score double")
    return scored.withColumn("keep", F.coalesce(F.col("score") >= model.threshold, F.lit(False)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
