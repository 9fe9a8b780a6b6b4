"""Operator 6, quality rules by an isolation forest on rule statistics.

Each document gets the statistics that quality rules look at. Random splits isolate odd documents after few steps, so a
short mean path marks an anomaly; the threshold on the score is calibrated from all labelled rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, known_labels, release, small, small_batches, table, type_of
from turnstone.llm.textbatch import CLASSES, WORD, mix, reduce_by_doc, slices, span_hashes, tokens

#: Trees, rows of a tree, labelled rows that trees are drawn from (by hash of doc_id), share of good documents to lose.
TREES, TREE_ROWS, FIT_ROWS, LOST, SEED = 128, 256, 8192, 0.01, 17

#: Length itself is no rule: it is the labels' business whether short texts are bad.
RULES = (
    "word_length", "upper_share", "digit_share", "sign_share", "distinct_words", "top_word_share", "line_copies",
    "open_lines", "sign_tokens", "long_words", "non_ascii", "pair_copies",
)
#: What every text is taken to have besides its own, unremarkable, so that a few words aren't an extreme.
BYTES, WORDS, LINES = 60, 12, 1


def _share(top: np.ndarray, below: np.ndarray, more: float) -> np.ndarray:
    return top / (below + more)


def _distinct(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each document has, and how often its most frequent one; by 48 bits of the values."""
    if not len(values):
        return np.zeros(docs), np.zeros(docs)
    both = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    runs, owner = np.diff(np.append(heads, len(both))), (both[heads] >> np.uint64(48)).astype(np.int64)
    return np.bincount(owner, minlength=docs).astype(float), reduce_by_doc(np.maximum, runs, owner, docs, 0).astype(float)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """documents x RULES, of whole texts."""
    docs = len(at) - 1
    size = np.diff(at).astype(float)
    running = lambda held: np.concatenate([[0], np.cumsum(held)])
    per_doc = lambda held: (lambda s: (s[at[1:]] - s[at[:-1]]).astype(float))(running(held))
    upper = per_doc((data >= 65) & (data <= 90)) + per_doc((data >= 0x80) & (data <= 0x9E) & (np.concatenate([[0], data[:-1]]) == 0xC3))
    lower = per_doc((data >= 97) & (data <= 122))
    digit = per_doc((data >= 48) & (data <= 57))
    kind = CLASSES[data]
    sign = per_doc(kind > WORD)
    starts, ends, doc = tokens(data, at)
    word = kind[starts] == WORD if len(starts) else np.empty(0, bool)
    ws, we, wd = starts[word], ends[word], doc[word]
    words = np.bincount(wd, minlength=docs).astype(float)
    hashes = span_hashes(data, ws, we)
    distinct, top = _distinct(hashes, wd, docs)
    if len(hashes) > 1:
        same = wd[1:] == wd[:-1]
        pairs = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])[same]
        pair_docs = wd[:-1][same]
    else:
        pairs, pair_docs = hashes[:0], wd[:0]
    pair_distinct, _ = _distinct(pairs, pair_docs, docs)
    # lines that are not empty
    line = np.where(data == 10, 0, 1).astype(np.int16)
    line_class = np.array([0, 1], np.int16)
    ls, le, ld = tokens(line.astype(np.uint8), at, line_class)
    lines = np.bincount(ld, minlength=docs).astype(float)
    line_distinct, _ = _distinct(span_hashes(data, ls, le), ld, docs)
    open_line = np.bincount(ld[~np.isin(data[le - 1], [33, 46, 58, 59, 63, 34, 41])] if len(ls) else ld, minlength=docs).astype(float)
    letters = np.bincount(wd, (we - ws).astype(float), minlength=docs)
    pair_count = np.bincount(pair_docs, minlength=docs)
    return np.stack(
        [
            (letters + 5 * WORDS) / (words + WORDS), _share(upper, upper + lower, BYTES), _share(digit, size, BYTES), _share(sign, size, BYTES),
            # the expected share of distinct words falls with length: compare on a log scale
            np.log1p(distinct + WORDS) / np.log1p(words + WORDS), _share(top, words, WORDS), _share(lines - line_distinct, lines, LINES),
            _share(open_line, lines, LINES), _share(np.bincount(doc[~word], minlength=docs), words, WORDS), _share(np.bincount(wd[(we - ws) > 30], minlength=docs), words, WORDS),
            _share(per_doc(data >= 128), size, BYTES), _share(pair_count - pair_distinct, pair_count, WORDS),
        ],
        1,
    )


def _measure(batches):
    """(doc_id, text) to (doc_id, rules), null rules for a null text."""
    for part, data, at in slices(batches):
        x = statistics(data, at)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(RULES)), pa.array(x.ravel()))
        yield pa.record_batch([part.column("doc_id"), lists, part.column("text").is_valid()], names=["doc_id", "rules", "there"])


class Forest(NamedTuple):
    """Trees as arrays of TREE nodes each: feature (-1 at a leaf), cut, left child (right is next), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    rows: int


def _mean_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Trees of random splits, each over its own draw of tree_rows rows, at most log2 of those deep."""
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    depth = int(np.ceil(np.log2(max(rows, 2))))
    width = 2 ** (depth + 1)
    feature, at = np.full((trees, width), -1, np.int16), np.zeros((trees, width))
    left, path = np.zeros((trees, width), np.int32), np.zeros((trees, width))
    for t in range(trees):
        held = x[rng.choice(len(x), rows, replace=False)]
        used, work = 1, [(0, held, 0)]
        while work:
            node, part, level = work.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else ()
            if level >= depth or not len(spread):
                path[t, node] = level + _mean_path(len(part))
                continue
            f = rng.choice(spread)
            lo, hi = part[:, f].min(), part[:, f].max()
            c = rng.uniform(lo, hi)
            feature[t, node], at[t, node], left[t, node] = f, c, used
            side = part[:, f] < c
            work += [(used, part[side], level + 1), (used + 1, part[~side], level + 1)]
            used += 2
    return Forest(feature, at, left, path, rows)


def anomaly(x: np.ndarray, forest: Forest) -> np.ndarray:
    """2^(-mean path / expected path) of each row: near 1 is odd, under 0.5 ordinary."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, at, left, path in zip(forest.feature, forest.cut, forest.left, forest.path):
        node = np.zeros(len(x), np.int32)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] >= at[node]
            node = np.where(inner, left[node] + right, node)
        total += path[node]
    return 2.0 ** (-total / len(forest.feature) / max(_mean_path(forest.rows), 1e-9))


def _judge(batches, forest: Forest):
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            part = batch.slice(lo, 8192)
            rules = part.column("rules")
            x = rules.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(RULES))
            yield pa.record_batch([part.column("doc_id"), pa.array(anomaly(x, forest)), part.column("there")], names=["doc_id", "score", "there"])


def anomalies(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lost: float = LOST) -> DataFrame:
    """(doc_id, score, keep) for every row of docs: keep is score <= threshold.

    The forest grows on at most fit_rows labelled rows, good and bad. The threshold is the score that parts labelled good
    from bad best (balanced accuracy), but no lower than the score that loses a share `lost` of the good. Where only one
    class is labelled nothing is rejected; where no document is, there is no forest, and scores are null. A null text has
    no score and isn't kept; an empty one has the statistics of what every text is taken to have besides its own
    (word_length 5, distinct_words 1, else 0). doc_id may be of any type; the labels' doc_ids are taken as of the same, and
    those that can't be so count for nothing. Null doc_ids are scored; repeated rows score the same; null labels count for
    nothing. Other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    kind = type_of(docs, "doc_id")
    measured = cut(docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, rules array<double>, there boolean"))
    known = cut(known_labels(docs, labels))
    labelled = measured.filter("there").join(small(known), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(SEED)), "doc_id"]
    share = int(min(1.0, 1.2 * fit_rows / max(labelled.count(), 1)) * (1 << 20))
    sample = labelled.filter(F.pmod(order[0], F.lit(1 << 20)) < share).orderBy(*order).limit(fit_rows).select("rules").toPandas()
    if not len(sample):
        return measured.select("doc_id", F.lit(None).cast("double").alias("score"), F.col("there").alias("keep"))
    forest = grow(np.stack(sample.rules.to_numpy()))
    scored = cut(measured.mapInArrow(lambda it: _judge(it, forest), f"doc_id {kind}, score double, there boolean"))
    release(measured)
    found = scored.filter("there").join(small(known), "doc_id").groupBy(F.round(F.col("score") * 2000).cast("int").alias("at"), (F.col("quality") > 0).alias("good")).count().toPandas()
    release(known)
    limit = threshold(found, lost)
    return scored.select("doc_id", F.when(F.col("there"), F.col("score")).alias("score"), (F.col("there") & (F.col("score") <= limit)).alias("keep"))


def threshold(found, lost: float) -> float:
    """From the histogram (at, good, count) of scores, in steps of 1/2000."""
    hist = np.zeros((2, 2001))
    np.add.at(hist, (found.good.astype(int), found["at"]), found["count"])
    bad, good = hist
    if not good.sum() or not bad.sum():
        return 1.0
    kept_good, kept_bad = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    best = int(np.argmax(kept_good - kept_bad))
    safe = int(np.argmax(kept_good >= 1 - lost))
    return (max(best, safe) + 0.5) / 2000


def op6_quality_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_anomalies": op6_quality_anomalies}
ORACLES: dict[str, str] = {}
