"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents into word ids of the benchmark's vocabulary (0 for any other word) and sorts the suffixes
that can match, in shards of bounded size, by their first `window` words. Every suffix of every benchmark item is
looked up in every shard by binary search; the range that shares its window gives the locations. Suffixes that start
with fewer benchmark words than the shortest window cannot match and are left out. Equal windows of the benchmark are
one probe, so a place in a document is hit at most once for each length of window, however often words repeat.

The longest verbatim match of a document is then the longest run of words, over its hit stretches, that an item it
hits also has: found by bisection over the length, as every run of a common run is common.

The benchmark is broadcast in blocks of bounded size; a document is split into words once and passes all blocks in one
task, without a shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, table, trimmed
from .hashing import mixed, runs

WINDOW = 10
#: Words of benchmark text in one broadcast block, and bytes of suffix keys in one shard.
BLOCK_WORDS, SHARD_BYTES = 500_000, 48_000_000
#: Lower-cases A-Z and turns all other ASCII but letters and digits to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "starts array<int>, ends array<int>, items array<string>, longest_words int, longest_item string, longest_at int"


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Probes:
    """A block of benchmark items: vocabulary, ids, and every distinct window as a key with the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        items = [(i, w) for i, w in items if w]
        self.window = window
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.names = [name for name, _ in items]
        self.words = [np.fromiter(map(self.ids.__getitem__, ws), np.uint32, len(ws)) for _, ws in items]
        self.shortest = min((min(len(w), window) for w in self.words), default=window)
        keys, owner = [np.zeros((0, window), ">u4")], [np.zeros(0, np.int64)]
        for k, a in enumerate(self.words):
            keys.append(np.lib.stride_tricks.sliding_window_view(a, window) if len(a) >= window else np.pad(a, (0, window - len(a)))[None])
            owner.append(np.full(len(keys[-1]), k))
        key = np.ascontiguousarray(np.concatenate(keys).astype(">u4")).view(f"S{4 * window}").ravel()
        self.low, back = np.unique(key, return_inverse=True)
        pair = np.unique(np.stack([back, np.concatenate(owner)]), axis=1)
        self.items = pair[1]
        self.first = np.searchsorted(pair[0], np.arange(len(self.low) + 1))
        low = np.frombuffer(self.low.tobytes(), ">u4").reshape(-1, window)
        self.length = np.count_nonzero(low, axis=1)
        inside = np.arange(window) < self.length[:, None]
        self.high = np.ascontiguousarray(np.where(inside, low, 0xFFFFFFFF).astype(">u4")).view(f"S{4 * window}").ravel()

    def items_of(self, probes: np.ndarray) -> np.ndarray:
        """The distinct items of distinct probes."""
        return np.unique(np.concatenate([self.items[self.first[p] : self.first[p + 1]] for p in probes]))


def search(seqs: list[np.ndarray], probes: Probes, shard_bytes: int = SHARD_BYTES):
    """Hits of all probes in the documents' id sequences: arrays of document, start and probe."""
    lengths, width = np.array([len(s) for s in seqs], np.int64), probes.window
    first = np.concatenate([[0], np.cumsum(lengths + 1)])  # a 0 ends each document
    a = np.zeros(first[-1] + width, np.uint32)
    for s, at in zip(seqs, first):
        a[at : at + len(s)] = s
    zeros = np.flatnonzero(a == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(a)))] - np.arange(len(a))
    starts = np.flatnonzero(run >= probes.shortest)
    out = []
    step = max(1, shard_bytes // (4 * width))
    for at in range(0, len(starts), step):
        some = starts[at : at + step]
        within = np.arange(width) < run[some][:, None]
        keys = np.where(within, np.lib.stride_tricks.sliding_window_view(a, width)[some], 0).astype(">u4")
        flat = np.ascontiguousarray(keys).view(f"S{4 * width}").ravel()
        order = np.argsort(flat, kind="stable")  # the shard's suffix array
        array = flat[order]
        lo, hi = np.searchsorted(array, probes.low, "left"), np.searchsorted(array, probes.high, "right")
        hit = np.flatnonzero(hi > lo)
        if len(hit):
            n = hi[hit] - lo[hit]
            entry = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)]
            doc = np.searchsorted(first, some[entry], "right") - 1
            out.append((doc, some[entry] - first[doc], np.repeat(hit, n)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _spaced(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts after one another, and the number of the part that each place is in, with one place between them."""
    owner = np.concatenate([np.full(len(p) + 1, k) for k, p in enumerate(parts)])
    return np.concatenate([np.append(p, np.uint32(0)) for p in parts]).astype(np.uint64), owner


def longest(seq: np.ndarray, starts: list[int], ends: list[int], probes: Probes, items: np.ndarray) -> tuple[int, str, int]:
    """Words, item and place of the longest run that hit stretches of seq share with items; of equal ones the first
    place, then the least item name."""
    stretches = [seq[s:e] for s, e in zip(starts, ends)]
    mine, part = _spaced(stretches)
    theirs, item = _spaced([probes.words[k] for k in items])
    offset = np.array(starts) - np.concatenate([[0], np.cumsum([len(p) + 1 for p in stretches])[:-1]])

    def common(n: int):
        """Places of runs of n words in mine that theirs has too, and their hashes."""
        x, y = runs(mixed(mine), n), runs(mixed(theirs), n)
        x_ok, y_ok = _inside(mine, n), _inside(theirs, n)
        at = np.flatnonzero(x_ok & np.isin(x, y[y_ok]))
        return at, x, y, y_ok

    low, high = 1, min(max(len(p) for p in stretches), max(len(probes.words[k]) for k in items))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
    at, x, y, y_ok = common(low)
    names = {probes.names[items[item[k]]] for k in np.flatnonzero(y_ok & (y == x[at[0]]))}
    return low, min(names), int(at[0] + offset[part[at[0]]])


def _inside(a: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place are free of zeros."""
    zeros = np.concatenate([[0], np.cumsum(a == 0)])
    return zeros[n:] == zeros[:-n]


def _merged(starts, ends) -> tuple[list[int], list[int]]:
    s, e = [], []
    for x, y in sorted(zip(starts, ends)):
        if s and x <= e[-1]:
            e[-1] = max(e[-1], y)
        else:
            s.append(x)
            e.append(y)
    return s, e


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Lists of (item, words), each of about block_words words at most; read from the table one part at a time."""
    block, n = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col(item_col).isNotNull()).toLocalIterator():
        block.append((r.i, item_words(r.t)))
        n += len(block[-1][1])
        if n >= block_words:
            yield block
            block, n = [], 0
    yield block


def _found(n_words: int, seq: np.ndarray, probes: Probes, start: np.ndarray, probe: np.ndarray, old: dict) -> dict:
    """What a document's hits in a block add to what was found before."""
    spans = _merged(start.tolist(), (start + probes.length[probe]).tolist())
    items = probes.items_of(np.unique(probe))
    n, name, at = longest(seq, *spans, probes, items)
    starts, ends = _merged(old["starts"] + spans[0], old["ends"] + spans[1])
    best = min((-n, at, name), (-(old["longest_words"] or 0), old["longest_at"] or 0, old["longest_item"] or ""))
    return {"n_words": n_words, "starts": starts, "ends": ends, "items": sorted({*old["items"], *(probes.names[k] for k in items)}), "longest_words": -best[0], "longest_at": best[1], "longest_item": best[2]}


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, found_col: str = "found") -> DataFrame:
    """docs with a struct column found_col of n_words, merged hit spans (starts, ends: word positions), items, and the
    longest verbatim match with its item and place (null where nothing matched; of equally long ones the first place,
    then the item that is least as a string).

    A window is `window` consecutive words of an item, or the whole item if it has fewer words but not none. Items with
    a null id are left out; items or documents without words or with a null text match nothing; repeated items count
    once, repeated documents each on their own. A column of docs of that name is replaced; all others stay.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != found_col]
    schema = docs.select(*kept).withColumn(found_col, F.lit(None).cast(f"struct<n_words: bigint, {FOUND.replace(' ', ': ').replace(',: ', ', ')}>")).schema
    group = uuid.uuid4().hex
    blocks = [Shared(spark, (block, window), group) for block in _blocks(benchmark, item_col, item_text_col, block_words)]
    kind = F.lit(None).cast(schema[found_col].dataType)
    none = {"starts": [], "ends": [], "items": [], "longest_words": None, "longest_item": None, "longest_at": None}

    @trimmed
    def run(batches):
        for b in batches:
            at, n = 0, len(b)
            while at < n:  # about a million words at a time
                split, size, end = [], 0, at
                while end < n and size < 1_000_000:
                    split.append((b.column(text_col)[end].as_py() or "").encode().translate(FOLD).split())
                    size, end = size + len(split[-1]), end + 1
                found = [none | {"n_words": len(ws)} for ws in split]
                for shared in blocks:
                    probes = shared.get(lambda value: Probes(*value))
                    if not probes.names:
                        continue
                    seqs = [np.fromiter(map(probes.ids.get, ws, (0,) * len(ws)), np.uint32, len(ws)) for ws in split]
                    doc, start, probe = search(seqs, probes)
                    order = np.argsort(doc, kind="stable")
                    hit, first = np.unique(doc[order], return_index=True)
                    for i, own in zip(hit, np.split(order, first[1:])):
                        found[i] = _found(len(split[i]), seqs[i], probes, start[own], probe[own], found[i])
                part = b.slice(at, end - at)
                at = end
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, part.schema.field(found_col).type)], names=part.schema.names)

    return docs.select(*kept).withColumn(found_col, kind).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    f = F.col("found")
    n_hit = F.aggregate(F.zip_with(f["starts"], f["ends"], lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort(f["items"]), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), f["longest_words"].alias("longest_words"), f["longest_item"].alias("longest_item"), f["longest_at"].alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents without a hit, with the columns of docs; rules as in find_matches."""
    name = "found"
    while name in docs.columns:
        name += "_"
    found = find_matches(docs, benchmark, window, text_col, found_col=name)
    return found.where(F.size(F.col(name)["starts"]) == 0).select(*docs.columns)


def op5_decontamination(spark, sf_dir):
    return digest(find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "found"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT CAST(item_id AS VARCHAR) AS item, s AS t, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
occ AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT o.doc_id, o.s, o.k, wins.item, wins.t FROM occ o JOIN wins ON wins.win = o.win AND wins.k = o.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, item, min(s) AS s, count(*) + k - 1 AS n
         FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item, k, s - t ORDER BY s) AS island FROM hits) GROUP BY doc_id, item, k, s - t, island),
best AS (SELECT doc_id, n, item, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, item) AS r FROM runs) WHERE r = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(best.n AS INTEGER) AS longest_words, best.item AS longest_item, CAST(best.s - 1 AS INTEGER) AS longest_at
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN best USING (doc_id)
"""
