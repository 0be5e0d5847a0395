"""Substring deduplication by level-wise doubling.

Runs of words that repeat across documents at one length alone are extended to twice that length, level by level, until
no candidate survives or the wanted length is reached. The levels' lengths are the wanted one halved until it is FIRST
words or fewer: 13, 25 and 50 for windows of 50 words, 13, 25, 50, 100, 200 and 400 for 400. A level holds one run for
each wanted window that survived so far: at the first, of the runs inside it the one that has the least hash; at the
next, the run around that one, of the level's length and inside the window; at the last, the window. Each choice depends
on the window's words alone, so copies of a window meet at every level. Neighbouring windows mostly choose the same run,
so at windows of 50 words about one start in twenty is shuffled at the first level.

Identical texts are one class and take part once, as their least id. Hashes are 64-bit at the level before the last and
again for the window, so a false repeat needs both to collide. Shuffled: 16 bytes an anchor or candidate, and a level's
texts with candidates by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Shared, dropped, stored, table
from .hashing import WordHashes, runs

WINDOW = 50
#: Words at most of the first level's runs. Shorter runs are common to documents that share nothing else.
FIRST = 13
#: Rows of a key beyond which it is joined by a broadcast; more where that would be 100,000 keys or over.
HOT_ROWS = 10_000
DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values the place of its least value, the first of equal ones."""
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return np.arange(len(view)) + view.argmin(axis=1)


def lengths_of(window: int, first: int = FIRST) -> list[int]:
    """The levels' lengths, at least two, each but for rounding twice the one before."""
    out = [(window + 1) // 2, window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Runs:
    """Of one document the starts of the first level's run in each window, and hashes of its runs of any length."""

    def __init__(self, text: str | None, lengths: list[int], hashes: WordHashes):
        ws = (text or "").encode().split()
        self.lengths, self.window = lengths, lengths[-1]
        self.a = hashes.of(ws) if len(ws) >= self.window else np.zeros(0, np.uint64)
        self.n = max(0, len(self.a) - self.window + 1)
        self.first = runs(self.a, lengths[0]) if self.n else self.a
        self.anchor = anchors(self.first, self.window - lengths[0] + 1) if self.n else np.zeros(0, np.int64)

    def at(self, level: int) -> np.ndarray:
        """For each window the hash of its run at a level."""
        if not self.n or not level:
            return self.first[self.anchor]
        start, s = self.anchor, np.arange(self.n)
        for shorter, length in zip(self.lengths[:level], self.lengths[1 : level + 1]):
            start = np.clip(start - (length - shorter) // 2, s, s + self.window - length)
        return runs(self.a, self.lengths[level])[start]


def _surviving(v: Runs, level: int, found) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose run at a level is among found, and that run's hashes."""
    h = v.at(level)
    s = np.flatnonzero(np.isin(h, np.array(found, np.int64).view(np.uint64)))
    return s, h[s]


def next_level(docs: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """(h, doc_id): the distinct runs of each document at a level, but for the first of the windows that survived the
    level before (column `found`) alone."""
    shared = Shared(docs.sparkSession, 1)

    def run(batches):
        hashes = shared.get(lambda _: WordHashes())
        for b in batches:
            ids, out = b.column("doc_id").to_numpy(zero_copy_only=False), [np.zeros(0, np.uint64)]
            for k, text in enumerate(b.column("text")):
                v = Runs(text.as_py(), lengths, hashes)
                at = v.at(level)
                out.append(np.unique(at[_surviving(v, level - 1, b.column("found")[k].as_py())[0]] if level else at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in out[1:]]), pa.int64())], names=["h", "doc_id"])

    return docs.select("doc_id", "text", *(["found"] if level else [])).mapInArrow(run, "h bigint, doc_id bigint")


def last_level(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(h, w, doc_id, th, s): the windows that survived the level before the last (column `found`)."""
    shared, before = Shared(docs.sparkSession, 1), len(lengths) - 2

    def run(batches):
        hashes = shared.get(lambda _: WordHashes())
        for b in batches:
            for k in range(len(b)):
                v = Runs(b.column("text")[k].as_py(), lengths, hashes)
                if not v.n:
                    continue
                s, h = _surviving(v, before, b.column("found")[k].as_py())
                w = runs(v.a, v.window)[s]
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(np.full(n, b.column("doc_id")[k].as_py(), np.int64)), pa.array(np.full(n, b.column("th")[k].as_py(), np.int64)), pa.array(s.astype(np.int32))], names=["h", "w", "doc_id", "th", "s"])

    return docs.select("doc_id", "th", "text", "found").mapInArrow(run, "h bigint, w bigint, doc_id bigint, th bigint, s int")


def with_few(docs: DataFrame, info: DataFrame, keys: list[str], column: str) -> DataFrame:
    """docs with a column of info, null where info has no row. Where the keys are counted and few, they are broadcast and
    only the rows that have one are shuffled; otherwise all are."""
    ids = info.select(*keys)
    if info.count() > BROADCAST_IDS:
        return docs.join(info, keys, "left")
    own = docs.join(F.broadcast(ids), keys, "left_semi").join(info, keys)
    rest = docs.join(F.broadcast(ids), keys, "left_anti").withColumn(column, F.lit(None).cast(info.schema[column].dataType))
    return own.unionByName(rest)


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that have candidates, with them."""
    few = found.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi") if few else docs
    return some.join(found, "doc_id")


def on_keys(rows: DataFrame, info: DataFrame, keys: list[str]) -> DataFrame:
    """rows (a stored table) joined with info, which has one row a key and n, the rows of that key. Hot keys are broadcast
    and their rows stay where they are: each has over 1/100,000 of all rows, so there are fewer than 100,000. The rows of
    all other keys are shuffled."""
    hot_rows = max(HOT_ROWS, rows.count() // 100_000)
    hot = info.where(F.col("n") > hot_rows).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(info.where(F.col("n") <= hot_rows).drop("n"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def repeats(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (doc_id, text) with `copy` (the text is that of a lesser id) and `starts` (of windows that a lesser id has)."""
    rows = rows.withColumn("th", F.xxhash64("text"))
    keyed = stored(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "th", F.sha2("text", 256).alias("key")).distinct(), "keys")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = stored(on_keys(keyed, least, ["key"]).where("doc_id > rep").select("doc_id", "th", F.lit(True).alias("copy")), "copies")
    dropped(keyed)
    few = copies.count() <= BROADCAST_IDS
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = known.join(F.broadcast(copies) if few else copies, ["doc_id", "th"], "left_anti")
    found, docs = None, own
    for level in range(len(lengths) - 1):
        here = stored(next_level(docs, lengths, level), "level")
        again = here.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
        last, found = found, stored(on_keys(here, again, ["h"]).groupBy("doc_id").agg(F.collect_list("h").alias("found")), "found")
        for done in (here, last):
            if done is not None:
                dropped(done)
        docs = with_found(own, found)
        if found.isEmpty():
            break
    full = stored(last_level(docs, lengths), "full")
    dropped(found)
    first = full.groupBy("h", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    starts = stored(on_keys(full, first, ["h", "w"]).where("first < doc_id").groupBy("doc_id", "th").agg(F.collect_set("s").alias("starts")), "starts")
    dropped(full)
    return with_few(with_few(rows, copies, ["doc_id", "th"], "copy"), starts, ["doc_id", "th"], "starts")


def _kept(rows: DataFrame, window: int, digest: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                n_words, n_removed, kept = [], [], []
                for text, copy, starts in zip(part.column("text"), part.column("copy"), part.column("starts")):
                    ws = (text.as_py() or "").encode().split()
                    gone = 0
                    if copy.as_py() and len(ws) >= window:
                        rest, gone = [], len(ws)
                    elif (s := starts.as_py()) and len(ws) >= window:
                        s = np.array(s, np.int64)
                        edge = np.zeros(len(ws) + 1, np.int64)
                        edge[s] += 1
                        edge[s + window] -= 1
                        hit = np.cumsum(edge)[:-1] > 0
                        rest, gone = [ws[k] for k in np.flatnonzero(~hit)], int(hit.sum())
                    else:
                        rest = ws
                    n_words.append(len(ws))
                    n_removed.append(gone)
                    joined = b" ".join(rest)
                    kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])

    return rows.select("doc_id", "text", "copy", "starts").mapInArrow(run, DIGEST if digest else DIGEST.replace("kept_sha256", "kept_text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one blank (or their SHA-256), one row per row of docs.

    A word goes if a window of `window` words covers it that also starts in a document with a lesser id; windows are
    judged on the input. A null or empty text has no words; texts under the window length lose nothing; a row with a
    null id loses nothing and takes nothing from others; repeated rows do not affect one another, as their ids are
    equal; an empty table gives an empty result; other columns are ignored. window: at least 2. first: words at
    most of the first level, which changes the work and not the result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return _kept(repeats(rows, lengths_of(window, first)), window, digest)


def op2_substring_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM hit),
pos AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
