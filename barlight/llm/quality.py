"""Quality rules: isolation forest on rule statistics.

Each document is reduced to the statistics of the rules, each told as its place among those of good documents. An isolation forest over all of them together, grown on a
bounded sample of labelled documents, isolates a row by random splits; a short mean path marks it as anomalous. Statistics that tell good and bad labelled
documents apart are drawn for a split more often than others. The threshold on the anomaly score is calibrated on labelled documents that the forest was not grown on.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Labelled documents that are used at most, one half to grow the forest and one to calibrate it.
SAMPLE_ROWS = 8000
#: A statistic is drawn for a split at least so often, against one that tells good and bad documents apart wholly.
LEAST_WEIGHT = 0.1


def stats_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The statistics of one whole text, in the order of STATS; bytes.split() cuts at exactly the six white characters of the word rule."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            often, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def features(stats: np.ndarray) -> np.ndarray:
    """Rule statistics as shares, so that long documents are no outliers: columns of STATS in, a row of features for each document out."""
    n, chars, symbols, dup, repeat, lines = (stats[:, i].astype(float) for i in range(len(STATS)))
    words = np.maximum(n, 1)
    return np.column_stack([symbols / words, chars / words, dup / np.maximum(lines, 1), repeat / words])


@dataclass
class Forest:
    """Trees as arrays: at an inner node the feature and the split, at a leaf the feature -1; both children are at left and left + 1."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float
    levels: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path / expected path)."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.levels):
                f = self.feature[t][at]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= self.split[t][at]
                at = np.where(inner, self.left[t][at] + right, at)
            total += self.depth[t][at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, weights: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None, trees: int = 100, rows: int = 256, seed: int = 17) -> Forest:
    """Trees over samples of the rows. A split's feature is drawn by weight, its place evenly over what the node has of the ``box`` (by default the range of the rows).

    Places are drawn over the box, not over the range of a node's rows, so that what lies where no row was seen is cut off as soon as a split falls between.
    """
    rng, levels = np.random.default_rng(seed), 12
    least, most = box or (x.min(axis=0), x.max(axis=0))
    grown = []
    for _ in range(trees):
        sample = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
        feature, split, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, sample, least, most, 0)]
        while todo:
            node, part, low, high, level = todo.pop()
            wide = np.flatnonzero(high > low)
            if level == levels or len(part) < 2 or not len(wide):
                depth[node] = level + _expected(len(part))
                continue
            f = int(rng.choice(wide, p=weights[wide] / weights[wide].sum()))
            s = rng.uniform(low[f], high[f])
            feature[node], split[node], left[node] = f, s, len(feature)
            under, over = high.copy(), low.copy()
            under[f] = over[f] = s
            for side, a, b in ((part[part[:, f] < s], low, under), (part[part[:, f] >= s], over, high)):
                todo.append((len(feature), side, a, b, level + 1))
                feature.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
        grown.append((feature, split, left, depth))
    size = max(len(g[0]) for g in grown)
    arrays = [np.array([list(g[i]) + [(-1, 0.0, 0, 0.0)[i]] * (size - len(g[i])) for g in grown]) for i in range(4)]
    return Forest(*arrays, norm=max(_expected(min(rows, len(x))), 1.0), levels=levels)


@dataclass
class Scale:
    """Quantiles of each feature among good rows without the outermost thousandths, and its width without the outermost tenths."""

    quantiles: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, good: np.ndarray, knots: int = 64) -> Scale:
        spread = np.quantile(good, 0.9, axis=0) - np.quantile(good, 0.1, axis=0)
        return cls(np.quantile(good, np.linspace(0.001, 0.999, knots), axis=0), np.maximum(spread, 0.02))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The share of good rows below, so that good rows are spread evenly from 0 to 1; beyond the quantiles, further by the logarithm of the distance in widths."""
        shares, out = np.linspace(0, 1, len(self.quantiles)), np.empty(x.shape)
        for k, q in enumerate(self.quantiles.T):
            # equal quantiles are one place, the lowest of theirs
            knots, first = np.unique(q, return_index=True)
            out[:, k] = np.interp(x[:, k], knots, shares[first])
            out[:, k] += np.log1p(np.maximum(0, x[:, k] - q[-1]) / self.width[k]) - np.log1p(np.maximum(0, q[0] - x[:, k]) / self.width[k])
        return out


def told_apart(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each feature how well it alone tells good rows from bad ones, from 0 to 1: the squared rank difference of a bad and a good row."""
    ranks = pd.DataFrame(x).rank().to_numpy()
    n, m = good.sum(), (~good).sum()
    share = (ranks[~good].sum(axis=0) - m * (m + 1) / 2) / (n * m)
    return (2 * share - 1) ** 2


@dataclass
class Verdict:
    """A forest over all rule statistics, the scale of its features, and the threshold on its score."""

    forest: Forest
    scale: Scale
    threshold: float

    def keep(self, stats: np.ndarray) -> np.ndarray:
        return self.score(stats) <= self.threshold

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.score(self.scale.place(features(stats)))


def calibrate(stats: np.ndarray, good: np.ndarray, most_lost: float = 0.0005, seed: int = 17) -> Verdict | None:
    """Grow the forest on one half of the labelled rows, put the threshold on the other.

    Trees grow on the good rows of the growing half, in the box of all its rows. The threshold rejects the most bad rows of the other half that it can with at most ``most_lost`` of the good. None if there are no rows
    of both kinds.
    """
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(stats)) % 2 == 0
    well, kind = np.flatnonzero(half & good), good[~half]
    if len(well) < 8 or not (half & ~good).any() or kind.all() or not kind.any():
        return None
    x = features(stats)
    scale = Scale.of(x[well])
    x = scale.place(x)
    weights = np.maximum(told_apart(x[half], good[half]), LEAST_WEIGHT)
    box = x[half].min(axis=0), x[half].max(axis=0)
    forest = grow(x[well], weights, box, seed=seed)
    scores = forest.score(x[~half])
    clean, junk = np.sort(scores[kind]), np.sort(scores[~kind])
    floor = clean[min(len(clean) - 1, int(np.ceil((1 - most_lost) * len(clean))))]
    above = junk[junk > floor]
    # midway between the clean scores and the next junk, so that neither kind stands at the edge
    return Verdict(forest, scale, float((floor + above[0]) / 2 if len(above) else max(floor, scores.max())))


def rule_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and STATS for every row."""

    def make(texts: list[str | None]) -> tuple:
        return None, list(zip(*map(stats_of, texts), strict=True)) or [[]] * len(STATS)

    return map_texts(docs, list(keep), "text", ", ".join(f"{s} long" for s in STATS), make)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Verdict | None:
    """The verdict from at most ``rows`` labelled documents, chosen by the hash of their ids.

    Labels whose quality is null don't count, nor do rows that fail the base rules: the forest judges the others. Only where those
    are too few of a kind all labelled rows count. Of a document that stands there with several texts that with
    the least statistics counts; of several labels the least.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rule_stats(found, ("doc_id", "quality")).groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "quality", "s.*")
    table = one.toPandas().sort_values("doc_id")
    stats, good = table[list(STATS)].to_numpy(dtype=np.int64), table["quality"].to_numpy() > 0
    fine = ~base_failed(stats[:, 0], stats[:, 4])
    verdict = calibrate(stats[fine], good[fine])
    return calibrate(stats, good) if verdict is None else verdict


def keep(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of documents that neither the base rules nor the forest rejects, with all columns, in one pass over the texts.

    A null or empty text has no words and goes. Rows with a null id and repeated rows are judged like others, by their text. An empty table
    gives no rows. Further columns may have any names.
    """
    small_batches(docs.sparkSession)
    verdict = learn(docs, labels, rows)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        stats = np.array([stats_of(t) for t in texts], dtype=np.int64).reshape(len(texts), len(STATS))
        out = ~base_failed(stats[:, 0], stats[:, 4])
        return pd.Series(out if verdict is None else out & verdict.keep(stats))

    return docs.where(good(F.col("text")))


def judge(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for every row.

    A null or empty text has no words and fails the base rules. Repeated rows get equal verdicts. Without labelled rows of both
    kinds the base rules alone decide. An empty table gives no rows. Further columns are ignored.
    """
    verdict = learn(docs, labels, rows)
    stats = rule_stats(docs)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    if verdict is None:
        kept = ~failed
    else:

        @F.pandas_udf("boolean")
        def normal(*cols: pd.Series) -> pd.Series:
            return pd.Series(verdict.keep(np.column_stack([c.to_numpy(dtype=np.int64) for c in cols])))

        kept = ~failed & normal(*[F.col(c) for c in STATS])
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
