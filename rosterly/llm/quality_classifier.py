"""A quality classifier: gradient-boosted trees on histograms of document statistics, scored as flat arrays.

Every whole text is read once for its statistics, which are stored. Spark's gradient-boosted trees, which split on
histograms of binned features that the tasks add up, learn from those of a bounded sample of labelled rows. The trees
are then laid out as arrays (feature, threshold, left, right, value), and tasks walk all trees for many documents at once
with numpy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, dropped, stored, table, trimmed

#: At most about so many labelled rows are learned from, chosen by a hash of the id.
TRAIN_ROWS = 40_000
TREES, DEPTH, BINS, STEP, SEED = 24, 4, 64, 0.3, 17
#: Partitions of the training sample.
PARTS = 6
CUT = 0.3
#: Sets of bytes whose share of a text is a feature.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "wide": bytes(range(128, 256)), "newline": b"\n",
    "space": b" \t\x0b\x0c\r", "stop": b".", "comma": b",;:", "loud": b"!?", "quote": b"\"'`", "bracket": b"()[]{}", "slash": b"/\\_-=+~^", "symbol": b"#*$%&@", "bar": b"|<>",
    "control": bytes(c for c in range(32) if c not in b"\t\n\x0b\x0c\r") + b"\x7f"}
FEATURES = (*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "entropy", "mean_word", "sd_word", "log_longest_word", "one_letter", "distinct_words", "top_word", "distinct_pairs",
            "log_lines", "mean_line", "blank_lines", "repeated_lines", "short_lines", "ended_lines")


def _classes() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES.values()):
        m[np.frombuffer(members, np.uint8), k] = 1
    return m


def statistics(text: bytes, classes: np.ndarray) -> list[float]:
    """The features of a text, in the order of FEATURES; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = seen[seen > 0] / n
    words = text.split()
    m = max(len(words), 1)
    long = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    k = max(len(full), 1)
    return [
        *(seen @ classes / n), np.log1p(n), np.log1p(len(words)), float(-(share * np.log2(share)).sum()),
        float(long.mean()), float(long.std()), np.log1p(long.max()), float((long == 1).sum()) / m, len(counts) / m, max(counts.values(), default=0) / m,
        len(set(zip(words, words[1:]))) / max(len(words) - 1, 1), np.log1p(len(lines)), len(words) / k, 1 - len(full) / len(lines), 1 - len(set(full)) / k,
        sum(len(x) < 30 for x in full) / k, sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in full) / k]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats, one row per row of docs; null counts as empty."""

    @trimmed
    def run(batches):
        classes = _classes()
        for b in batches:
            rows = [statistics(t.as_py() or b"", classes) for t in b.column("text")]
            flat = pa.array(np.array(rows, np.float64).ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), flat)], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, stats array<double>")


class Trees(NamedTuple):
    """All trees of a forest one after the other. A leaf is its own left and right."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of a leaf, times the weight of its tree
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of the trees' leaves for each row of x, in blocks of rows."""
        out = np.full(len(x), self.base)
        if not len(self.root):
            return out
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            node, row = np.repeat(self.root[None], len(part), 0), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + 2048] += self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margin(x)))


def flattened(model) -> Trees:
    """The arrays of a fitted GBTClassificationModel."""
    rows, roots = [], []
    for tree, weight in zip(model.trees, model.treeWeights):
        roots.append(len(rows))
        waiting = [(tree._call_java("rootNode"), None, None)]
        while waiting:
            node, parent, side = waiting.pop()
            here = len(rows)
            if parent is not None:
                rows[parent][side] = here
            if node.subtreeDepth():
                split = node.split()
                rows.append([split.featureIndex(), split.threshold(), here, here, 0.0])
                waiting += [(node.leftChild(), here, 2), (node.rightChild(), here, 3)]
            else:
                rows.append([0, 0.0, here, here, weight * node.prediction()])
    feature, threshold, left, right, value = (np.array(c) for c in zip(*rows))
    return Trees(np.array(roots), feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), max(t.depth for t in model.trees), 0.0)


def trained(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees learned from the rows of stats (doc_id, stats) that labels (doc_id, label of 0 or 1) names. With more than
    `most` labels those are taken whose ids have the least hashes, by a threshold. Without labels, or with one class
    alone, there are no trees and every score is the smoothed share of ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("double").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < most * 1_000_000 // n)
    sample = stored(stats.join(F.broadcast(known), "doc_id").select("label", array_to_vector("stats").alias("features")).repartition(PARTS), "sample")
    ones, rows = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, rows):
        dropped(sample)
        none = np.zeros(0, np.int64)
        return Trees(none, none, none, none, none, none, 0, 0.5 * float(np.log((ones + 1) / (rows - ones + 1))))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=BINS, stepSize=STEP, seed=SEED, minInstancesPerNode=5, cacheNodeIds=False).fit(sample)
    dropped(sample)
    return flattened(model)


def scored(stats: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score, the likelihood of label 1, for each row of stats."""
    shared = Shared(stats.sparkSession, model)

    @trimmed
    def run(batches):
        m = shared.get(lambda v: v)
        for b in batches:
            x = np.asarray(b.column("stats").flatten()).reshape(len(b), len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels has doc_id and quality.

    Rows whose crc32 of the id, modulo folds, is 0 are held out and never learned from. Null and empty texts are scored by
    zeros. A null id is held out of learning as no label can name it, but held_out is false. Repeated rows and repeated
    labels each count; labels that are null or neither 0 nor 1, and those of unknown ids, are ignored. An empty table of
    documents gives an empty result; without labels of both classes all scores are one constant. Other columns are
    ignored.
    """
    stats = stored(with_statistics(docs, id_col, text_col), "stats")
    model = trained(stats, labels.where(remainder(folds) != 0).select("doc_id", F.col("quality").alias("label")), most)
    out = scored(stats, model)
    return out.select("doc_id", F.coalesce(remainder(folds) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def op12_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
