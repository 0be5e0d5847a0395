"""Periodic runs of words by string synchronising sets, and texts with the repetitions taken out.

A run is a maximal stretch of words with smallest period q that is at least LEAST words and TIMES * q long. Periods up
to FIRST are found by comparing all words with those p further on. The others are found scale by scale. The scale of
periods in (m, 2m], m = FIRST, 2 * FIRST, ..., has windows of t = m / 2 words and the synchronising set S of t:

- every window has a hash as its id, but those with a period of t / 3 at most, which lie in highly periodic regions, have
  none: such regions are runs with small periods and already found, by the lag comparison or at a smaller scale;
- i is in S if the least id of the windows at i .. i + t is that at i or at i + t. So whether i is in S depends on the 2t
  words at i alone, and t consecutive places without a member of S lie in a highly periodic region.

In a run of period q all places of S recur q further on. Of two neighbouring places of S with equal contexts of c words
the distance is a proposed period: with c = 3m / 2 for q up to c, else c = 2m, the context is at least q long, so no
shorter distance can be between them in a run of smallest period q, and the first place of S in a run, at most t from its
start or just after a highly periodic beginning, has q + c words after it as the run is 3q long. Each proposal is checked and
extended both ways on the words themselves, so what is returned is exact. A document takes O(n log^2 n) time and O(n)
memory; documents do not depend on one another, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, table, trimmed, words
from .hashing import BASE, mixed

LEAST, TIMES, FIRST = 24, 3, 8
#: Words that are worked on at once, if no document is longer.
CHUNK = 150_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def equal_stretches(a: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of a with period p that are longer than p."""
    same = np.zeros(max(len(a) - p, 0) + 2, np.bool_)
    same[1:-1] = a[p:] == a[: len(a) - p] if p < len(a) else False
    edges = np.flatnonzero(same[1:] != same[:-1])
    return edges[::2], edges[1::2] + p


def extended(a: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The maximal stretch around i, i + q in which words q apart are equal."""
    left, step = i, 64
    while left > 0:
        s = max(0, left - step)
        unlike = np.flatnonzero(a[s:left] != a[s + q : left + q])
        if len(unlike):
            left = s + int(unlike[-1]) + 1
            break
        left, step = s, step * 2
    right, step, last = i, 64, len(a) - q
    while right < last:
        e = min(last, right + step)
        unlike = np.flatnonzero(a[right:e] != a[right + q : e + q])
        if len(unlike):
            right += int(unlike[0])
            break
        right, step = e, step * 2
    return left, right + q


def synchronising(ids: np.ndarray, t: int) -> np.ndarray:
    """The places of the synchronising set, given an id for each window of t words (NONE: highly periodic)."""
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(ids) - t
    least = np.minimum(least[:n], ids[t:])
    return np.flatnonzero(((least == ids[:n]) | (least == ids[t:])) & (least != NONE))


def runs_of(a: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a, by start. a holds numbers for words; texts of at most `longest` words in it
    are parted by numbers that occur once, which no run can contain."""
    found, regions = {}, []

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST, TIMES * q) and q < found.get((start, end), q + 1):
            found[start, end] = q
            regions.append((start, end, q))

    for p in range(1, min(FIRST, longest // TIMES) + 1):
        starts, ends = equal_stretches(a, p)
        long = ends - starts >= max(LEAST, TIMES * p)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            keep(s, e, p)
    m, width, h = FIRST, 1, mixed(a.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    while width < FIRST // 2:
        h = mixed(h[:-width] * np.uint64(BASE) + h[width:])
        width *= 2
    while TIMES * (m + 1) <= longest and len(h) > m // 2:
        t = m // 2
        after = mixed(h[:-t] * np.uint64(BASE) + h[t:])  # of m words
        ids = h.copy()
        periodic = np.zeros(len(h) + 1, np.int32)
        if t < LEAST:  # regions shorter than a run count too
            for p in range(1, t // 3 + 1):
                starts, ends = equal_stretches(a, p)
                long = ends - starts >= t
                np.add.at(periodic, starts[long], 1)
                np.add.at(periodic, ends[long] - t + 1, -1)
        else:
            for s, e, p in regions:
                if 3 * p <= t <= e - s:
                    periodic[s] += 1
                    periodic[e - t + 1] -= 1
        ids[np.cumsum(periodic[:-1]) > 0] = NONE
        places = synchronising(ids, t)
        proposed = []
        for c, above, up_to in ((m + t, m, m + t), (2 * m, m + t, 2 * m)):
            rest = after[m:] if c == 2 * m else h[m:]
            at = places[places < len(rest)]
            context = after[at] * np.uint64(BASE) + rest[at]
            order = np.argsort(context, kind="stable")
            at, context = at[order], context[order]
            gap = at[1:] - at[:-1]
            near = (context[1:] == context[:-1]) & (gap > above) & (gap <= up_to)
            proposed += zip(gap[near].tolist(), at[:-1][near].tolist())
        last = (0, 0)
        for q, i in sorted(proposed):
            if last[0] == q and i + q < last[1]:
                continue
            s, e = extended(a, i, q)
            last = (q, e)
            keep(s, e, q)
        h, m = after, 2 * m
    return sorted((s, e, q) for (s, e), q in found.items())


def _chunks(texts: list[list[bytes]]):
    """Places of texts, the shortest first, in groups of about CHUNK words."""
    group, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if group and size + len(texts[k]) > CHUNK:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(texts[k]) + 1
    if group:
        yield group


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group in _chunks(texts):
        numbers: dict[bytes, int] = {}
        size = sum(len(texts[k]) + 1 for k in group)
        a, at, firsts = np.empty(size, np.int64), 0, []
        for parted, k in enumerate(group):
            n = len(texts[k])
            a[at : at + n] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[k]), np.int64, n)
            a[at + n] = -1 - parted
            firsts.append(at)
            at += n + 1
        found = runs_of(a, len(texts[group[-1]]))
        for (s, e, q), of in zip(found, np.searchsorted(firsts, [s for s, _, _ in found], side="right") - 1):
            out[group[of]].append((s - firsts[of], e - s, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(text)
    keep = np.ones(len(text), np.bool_)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([text[k] for k in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and the collapsed text, one row
    per row of docs.

    Words are [^\\x20\\x09-\\x0D]+, unchanged and numbered from 0. A null or empty text has no words, no runs and an empty
    collapsed text. A null id stays null; repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored whatever their names.
    """

    @trimmed
    def run(batches):
        for b in batches:
            texts = [(t.as_py() or b"").split() for t in b.column("text")]
            found = runs_of_texts(texts)
            flat = [r for runs in found for r in runs]
            parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(RUN))),
                pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the crc32 of the id in decimal and g = floor(h / 10), a tenth of the documents (h % 10 = 0)
    repeat themselves from word g % n on, with period 1 + floor((n - a) / (3 + g % 8)). Null ids are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        spans = let(F.struct((g % n).alias("a")), lambda s: F.struct(s["a"].alias("a"), (1 + F.floor((n - s["a"]) / (3 + g % 8))).alias("p")))
        return let(spans, lambda s: F.array_join(F.transform(w, lambda x, i: F.when(i >= s["a"], F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int"))).otherwise(x)), " "))

    planted = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    higher = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(higher(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Words are compared in windows of 16: equal windows at a distance of at most a third of the text are all there in a run
#: (24 - 8 words at periods up to 8, two periods at longer ones), and neighbouring pairs make one stretch.
SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
              CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) END AS h FROM documents, tab),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM d1),
d AS (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN a = n THEN w ELSE list_concat(w[1 : a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) END AS w FROM d2),
win AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS k FROM (SELECT r, w, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 24)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM win x JOIN win y ON x.r = y.r AND x.k = y.k AND x.i < y.i),
isl AS (SELECT r, q, min(i) AS s, count(*) + 15 + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM pairs) GROUP BY r, q, grp),
run AS (SELECT r, s, len, min(q) AS q FROM isl WHERE len >= greatest(24, 3 * q) GROUP BY r, s, len),
dig AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM run GROUP BY r),
best AS (SELECT r, s, len, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len / q DESC, s, q) AS rn FROM run) WHERE rn = 1),
dropped AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + q, s + len)) AS i FROM run) GROUP BY r),
kept AS (SELECT d.r, array_to_string(list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') AS t FROM d JOIN dropped USING (r))
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.t, array_to_string(d.w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN dig USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
