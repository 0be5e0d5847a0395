"""Periodic runs, the quality classifier and whitening against brute force, an eigensolver and held-out labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterly.llm import embedding_whitening, periodic_runs, quality_classifier
from rosterly.llm.common import table
from tests.llm.test_operators import corpus, frame, rows_of

SF = "/root/testdata/sf0.01"


def brute_runs(w):
    """Every stretch of equal words q apart, for every q; of one stretch the smallest q."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        unit = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 10, 40, 90])))]
        if rng.random() < 0.3:  # a long stretch of one word inside a period
            unit += [b"z"] * rng.randint(1, 60)
        w = (w + unit * rng.randint(1, rng.choice([2, 4, 9, 30])))[:700]
        if rng.random() < 0.3:
            w = w + w[-rng.randint(1, 300) :]
    return ((w * 4)[:900] if rng.random() < 0.2 else w)[: rng.choice([20, 24, 100, 900])]


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(150)]
    assert periodic_runs.runs_of_texts(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("chunk", [1, 500])
def test_runs_do_not_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    texts = [repetitive(random.Random(9)) for _ in range(20)] + [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 5000]
    assert periodic_runs.runs_of_texts(texts) == [brute_runs(t) for t in texts]


def test_runs_of_words_whose_powers_have_many_runs():
    a, b = [b"a"], [b"b"]
    for _ in range(14):
        a, b = a + b, a
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(700)]
    assert periodic_runs.runs_of_texts([a, thue, thue[:90] * 6]) == [brute_runs(a), brute_runs(thue), brute_runs(thue[:90] * 6)]


def brute_digest(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_with_edge_cases(spark, tmp_path):
    rng = random.Random(4)
    docs = corpus(seed=8, n=200) + [(1000 + k, b" ".join(repetitive(rng)).decode()) for k in range(40)] + [(-7, "x " * 400), (2**60, "é ü " * 30)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(periodic_runs.op11_periodic_runs(spark, str(tmp_path))) == rows_of(spark.createDataFrame([brute_digest(*d) for d in docs], periodic_runs.op11_periodic_runs(spark, str(tmp_path)).schema))
    assert periodic_runs.periodic_runs(frame(spark, docs).limit(0)).collect() == []
    got = periodic_runs.periodic_runs(frame(spark, [(1, "a b " * 20 + "end"), (None, None)])).collect()
    assert rows_of(spark.createDataFrame([(r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in got], "a long, b long, c long, d string")) == rows_of(spark.createDataFrame([(1, 41, 1, "a b end"), (None, 0, 0, "")], "a long, b long, c long, d string"))


def test_statistics_are_finite_for_every_text():
    classes = quality_classifier._classes()
    for text in (b"", b" ", b"\n\n", b"\x00", b"a", b"a " * 30_000, "añil ｘ　y".encode(), bytes(range(32, 127))):
        row = quality_classifier.statistics(text, classes)
        assert len(row) == len(quality_classifier.FEATURES) and all(map(math.isfinite, row))


def test_flat_trees_give_what_the_model_gives(spark):
    stats = quality_classifier.with_statistics(table(spark, SF, "documents")).where("doc_id % 3 = 0")
    rows = stats.select(F.col("doc_id") % 2 == 0, "stats").toDF("even", "stats").select(F.col("even").cast("double").alias("label"), quality_classifier.array_to_vector("stats").alias("features")).cache()
    model = quality_classifier.GBTClassifier(maxIter=4, maxDepth=4, seed=1).fit(rows)
    want = [float(r.probability[1]) for r in model.transform(rows).collect()]
    x = np.array([r.features.toArray() for r in rows.collect()])
    assert np.allclose(quality_classifier.flattened(model).score(x), want, rtol=1e-12)


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_classifier.quality_scores(docs, labels)
    assert got.count() == docs.count()
    held = [r for r in got.join(labels, "doc_id").where("held_out").collect()]
    assert {r.held_out for r in held} == {zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held} == {True}
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    ones, zeros = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) >= 0.9 * len(ones) * len(zeros)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents").where("doc_id < 300"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality_classifier.remainder(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = rows_of(quality_classifier.quality_scores(docs, labels))
    assert rows_of(quality_classifier.quality_scores(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit(1), "stats": F.lit(2)}), turned)) == one
    assert all(r[2] == (r[1] >= 0.3) for r in [(k[1], k[2], k[3]) for k in one])


def test_quality_edge_cases(spark):
    docs = frame(spark, corpus(n=30))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 7, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).collect() == []
    two = labels.union(spark.createDataFrame([(k, k % 2, 0) for k in range(4, 30)], labels.schema))
    scores = [r.score for r in quality_classifier.quality_scores(docs, two).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(set(scores)) > 1
    assert all(0 <= r.score <= 1 for r in quality_classifier.quality_scores(docs, two, most=10).collect())


def vectors(spark, rows, schema="vec_id long, embedding array<float>, label int, n int, x string, id string"):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], schema)


def brute_whitened(data, most=32):
    """Per component: eigenvalue share; and n, exact deviations and absolute whitened values by an eigensolver."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in data], object)
    n, sums = len(x), x.sum(0)
    y = n * x - sums
    c = y.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    return n, [int(v) for v in (y * y).sum(1)], np.abs(c @ u[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


@pytest.mark.parametrize("d, most", [(1, 32), (2, 32), (7, 5), (40, 32), (64, 32)])
def test_whitening_equals_an_eigensolver(spark, d, most):
    rng = np.random.default_rng(d)
    data = (rng.normal(size=(300, d)) * np.linspace(1, 4, d)).astype(np.float32)
    got = embedding_whitening.whitened(vectors(spark, [(k, v.tolist()) for k, v in enumerate(data)]), most).collect()
    n, deviations, white, shares = brute_whitened(data, most)
    assert len(got) == 300 * len(shares) and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == deviations[r.vec_id] and abs(r.explained - shares[r.component - 1]) <= 1e-9
        assert abs(abs(r.whitened) - white[r.vec_id, r.component - 1]) <= 1e-6
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_leaves_out_what_has_no_finite_numbers(spark):
    rng = np.random.default_rng(1)
    good = [(k % 30, rng.normal(size=5).astype(np.float32).tolist()) for k in range(60)] + [(None, [1.0] * 5)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0]), (106, [1e30] * 5)]
    got = embedding_whitening.whitened(vectors(spark, good + bad)).collect()
    n, deviations, white, shares = brute_whitened([v for _, v in good])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation) for r in got) == sorted((i is None, i or 0, c + 1, v) for (i, _), v in zip(good, deviations) for c in range(5))
    assert {r.n for r in got} == {61} and max(abs(r.explained - shares[r.component - 1]) for r in got) < 1e-9


def test_whitening_without_spread_or_rows(spark):
    assert embedding_whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert embedding_whitening.whitened(vectors(spark, [(1, None)])).collect() == []
    flat = [(k, [float(k), 2.0 * k, 3.0]) for k in range(50)]  # rank 1
    got = embedding_whitening.whitened(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and abs(got[0].explained - 1) < 1e-12


def test_deviations_that_need_more_than_63_bits():
    x, sums = np.array([[2**40, 5], [3, 5]], np.int64), np.array([2**40 + 3, 10], object)
    assert embedding_whitening._deviations(x, 2, sums).to_pylist() == [None, None]
    x, sums = np.array([[2**30, 5], [3, 5]], np.int64), np.array([2**30 + 3, 10], object)
    assert embedding_whitening._deviations(x, 2, sums).to_pylist() == [(2**30 - 3) ** 2] * 2


@pytest.mark.parametrize("d", [1, 2, 3, 17])
def test_the_factor_and_its_rotation(d):
    rng = np.random.default_rng(d)
    for rank in {1, d}:
        b = rng.normal(size=(d, rank))
        v = b @ b.T
        factor, order = embedding_whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[order][:, order])
        values, columns = embedding_whitening.eigen(v, d)
        assert np.allclose(columns.T @ columns, np.eye(rank)) and np.allclose(columns * values @ columns.T, v)
