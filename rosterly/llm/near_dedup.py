"""Near-duplicate detection with circulant MinHash, banding and exact verification.

A document's set is its distinct 5-word shingles. Two permutations serve for all signature coordinates: the first
spreads the shingles over a universe of 2^32 slots; the second ranks the slots, and coordinate k is the least rank under
it shifted circularly by k slots. Both are bijections computed by arithmetic, so no table bounds the universe. Bands of
coordinates give candidate buckets; every link is confirmed on full sets.

Shape of the job, for groups of any size without all pairs:
1. One pass makes set size, set hash and bands. Documents with equal sets form a class; its least id stands for it.
   Sets of one or two shingles are similar enough to equal sets alone, so they have no bands.
2. In each bucket every class is compared with the bucket's least id (a star), and links give components. The pairs of
   a large bucket are dealt to parts of about STAR_PAIRS, each with its own copy of the least id's set.
3. Only buckets that still hold several components are looked at again. Members of a bucket's largest component need
   no comparing with one another, so only the strays, the members of its other components, are dealt to blocks and
   held against all members. A group is a block of strays and a block of members, both of bounded size; it returns
   links alone. Inside a group an index of each member's rarest shingles gives a stray its candidates: sets that are
   similar enough share one of those, so pages of one template that are not linked are hardly ever compared. New links
   give the final components.
A pair with similarity s misses every bucket with probability about (1 - s^4)^32, 5e-6 at 0.75, the least that is
linked; circulant coordinates are not quite independent, so a test measures the share of pairs that meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Shared, dropped, stored, table, trimmed
from .hashing import WordHashes, mixed, runs

SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 32, 4
#: Shingles in one block of members.
BLOCK_SHINGLES = 1_000_000
#: Pairs of one bucket that are compared with one copy of the set of its least id.
STAR_PAIRS = 1_000
#: The largest n with 100 * n < PERCENT * (n + 1): sets of up to n shingles are linked with equal sets alone.
MAX_EQUAL_ONLY = PERCENT // (100 - PERCENT) - (PERCENT % (100 - PERCENT) == 0)
SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, bands binary"


def shingles(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The set as sorted distinct 64-bit hashes; fewer words than k make one shingle, none make none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    a = hashes.of(words)
    return np.unique(runs(a, k)) if len(a) >= k else runs(a, len(a)) ^ np.uint64(len(a))


def _permuted(x: np.ndarray, odd: tuple[int, int, int]) -> np.ndarray:
    """A bijection of 32-bit integers, in place: multiplications by odd numbers and shifts folded in."""
    for k, times in enumerate(odd):
        x *= np.uint32(times)
        x ^= x >> np.uint32((15, 13, 16)[k])
    return x


class Circulant:
    WIDTH = BANDS * ROWS
    FIRST, SECOND = (0x2C1B3C6D, 0x297A2D39, 0x85EBCA6B), (0x9E3779B1, 0x7FEB352D, 0x846CA68B)

    def __init__(self):
        self.hashes, self.shifts = WordHashes(), np.arange(self.WIDTH, dtype=np.uint32)

    def signature(self, s: np.ndarray) -> np.ndarray:
        slots = _permuted((s ^ (s >> np.uint64(32))).astype(np.uint32), self.FIRST)
        least = np.full(self.WIDTH, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(slots), 1024):
            np.minimum(least, _permuted(slots[at : at + 1024, None] + self.shifts, self.SECOND).min(axis=0), out=least)
        return least

    def bands(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band; none for a set that only an equal one can be linked with."""
        if len(s) <= MAX_EQUAL_ONLY:
            return np.zeros(0, np.uint64)
        rows = self.signature(s).reshape(BANDS, ROWS).astype(np.uint64)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mixed(h + rows[:, r] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
        return h


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, set size, set hash and bands of each row; bands are empty for a set that has none."""
    shared = Shared(docs.sparkSession, 1)

    @trimmed
    def run(batches):
        c = shared.get(lambda _: Circulant())
        for b in batches:
            n, key, bands = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), c.hashes)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(c.bands(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.mapInArrow(run, SIGNED)


def banded(reps: DataFrame) -> DataFrame:
    """(rep, n_shingles, band, key) for every band of a class."""

    @trimmed
    def run(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(x.as_py() for x in b.column("bands")), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(b.column("rep").to_numpy(zero_copy_only=False), BANDS)), pa.array(np.repeat(b.column("n_shingles").to_numpy(zero_copy_only=False), BANDS)),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b))), pa.array(raw)], names=["rep", "n_shingles", "band", "key"])

    return reps.where(F.length("bands") > 0).select("rep", "n_shingles", "bands").mapInArrow(run, "rep bigint, n_shingles bigint, band int, key bigint")


def of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined on doc_id; the ids are broadcast if counted and few, shuffled otherwise."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def set_table(docs: DataFrame) -> DataFrame:
    shared = Shared(docs.sparkSession, 1)

    @trimmed
    def run(batches):
        hashes = shared.get(lambda _: WordHashes())
        for b in batches:
            sets = [shingles(t.as_py(), hashes).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * n >= PERCENT * (len(x) + len(y) - n)


def linked(multi: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (head, rep) of buckets whose full sets are similar enough. multi: head, rep and n, the bucket's members.
    A head has parts for its largest bucket; a pair takes the part that rep has among those for its own bucket."""
    parts = F.ceil(F.max("n") / STAR_PAIRS).cast("int")
    pairs = multi.where("head < rep").groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(parts.alias("parts"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    heads = multi.groupBy(F.col("head").alias("a")).agg(parts.alias("parts")).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    heads = heads.select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(heads, ["a", "part"]).select("a", "b", "sa", "sb")

    @trimmed
    def run(batches):
        for b in batches:
            yes = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("sa"), b.column("sb"))]
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return full.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the least node that can be reached. Each round takes the least label of
    all neighbours and then the label's own label, so that chains shorten by half; rounds end when no label changes."""
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        hooked = labels.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("least"))
        after = stored(hooked.join(jump, "label").select("node", F.col("least").alias("label"), (F.col("least") != F.col("old")).alias("moved")), "labels")
        dropped(labels)
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            dropped(both)
            return labels


def prefixes(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets after one another, n[k] shingles (numbers from 0) in set k: the set and the shingle of each entry of their
    prefixes, and whether the entry is in the short prefix too. A prefix is a set's first shingles, those that fewest
    sets have first. Similar enough sets have PERCENT of the larger in common and 2 * PERCENT / (100 + PERCENT) of the
    smaller, so their rarest common shingle is in the prefix of the larger and in the short prefix of the smaller."""
    own = np.repeat(np.arange(len(n)), n)
    rank = np.empty(int(flat.max()) + 1, np.int64)
    rank[np.argsort(np.bincount(flat), kind="stable")] = np.arange(len(rank))
    order = np.lexsort((rank[flat], own))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    entry = place < (n + (-PERCENT * n) // 100 + 1)[own]
    short = place < (n + (-2 * PERCENT * n) // (100 + PERCENT) + 1)[own]
    return own[order[entry]], flat[order[entry]], short[entry]


class Holders:
    """For each shingle the sets that have it among the given entries."""

    def __init__(self, shingle: np.ndarray, own: np.ndarray, size: int):
        order = np.argsort(shingle, kind="stable")
        self.own, self.begin = own[order], np.searchsorted(shingle[order], np.arange(size + 1))

    def of(self, shingles: np.ndarray) -> list[np.ndarray]:
        return [self.own[self.begin[t] : self.begin[t + 1]] for t in shingles]


def cross_links(members: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between different components that share a bucket. members: key, band, rep, n_shingles, label, of buckets
    with several labels. Per bucket, strays (members outside its largest component) and all members are each dealt to
    blocks of about BLOCK_SHINGLES; a group is one block of each."""
    size = members.groupBy("key", "label").agg(F.sum("n_shingles").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK_SHINGLES).cast("int")
    size = size.select("key", "main", blocks(F.col("n")).alias("bs"), F.greatest(blocks(F.col("n") - F.col("most")), F.lit(1)).alias("ss"))
    dealt = members.join(size, "key").withColumn("stray", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("rep"), F.col("bs")).cast("int")
    every = dealt.select("key", "band", "rep", "label", F.lit(False).alias("stray"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("ss") - 1)).alias("j"))
    some = dealt.where("stray").select("key", "band", "rep", "label", "stray", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), F.col("ss")).cast("int").alias("j"))
    full = every.unionByName(some).join(reps.select("rep", "bands"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")

    def run(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        rep, stray = group.column("rep").to_numpy(), group.column("stray").to_numpy()
        _, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
        data = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        bands = np.frombuffer(b"".join(x.as_py() for x in group.column("bands")), np.int64).reshape(-1, BANDS)
        n = np.array([len(s) for s in data])
        _, flat = np.unique(np.concatenate(data), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(flat.max()) + 1, np.bool_)
        own, rare, short = prefixes(flat, n)
        asked = np.searchsorted(own, np.arange(len(n) + 1))
        member = ~stray[own]
        as_larger, as_smaller = (Holders(rare[of], own[of], len(mark)) for of in (member, member & short))
        links = []
        for i in np.flatnonzero(stray):
            mine = slice(asked[i], asked[i + 1])
            rest = np.unique(np.concatenate(as_smaller.of(rare[mine]) + as_larger.of(rare[mine][short[mine]])))
            rest = rest[(label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i]))]
            if band:  # a pair is looked at in the first band that it shares
                rest = rest[~(bands[rest, :band] == bands[i, :band]).any(axis=1)]
            if not len(rest):
                continue
            mark[flat[first[i] : first[i + 1]]] = True
            for k in rest:
                if label[k] == label[i]:
                    continue
                both = int(np.count_nonzero(mark[flat[first[k] : first[k + 1]]]))
                if 100 * both >= PERCENT * (n[i] + n[k] - both):
                    links.append((rep[i], rep[k]))
                    label[label == label[i]] = label[k]
            mark[flat[first[i] : first[i + 1]]] = False
        return pa.table({"a": pa.array([int(min(x)) for x in links], pa.int64()), "b": pa.array([int(max(x)) for x in links], pa.int64())})

    return full.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and kept (doc_id = component_id), one row per row.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. A null or empty text has an empty set and is linked with
    nothing. A row with a null id is linked with nothing, has a null component and is kept. Rows that share an id are
    one document, linked by each of its texts. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(signed(rows), "signed")
    real = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(real.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(real.join(classes, "set_hash").where("doc_id = rep").select("rep", "n_shingles", "set_hash", "bands").dropDuplicates(["rep", "set_hash"]), "reps")
    bands = banded(reps)
    heads = bands.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count("*").alias("n")).where("head < last").drop("last")
    multi = stored(bands.join(heads, "key"), "buckets")
    sets = stored(set_table(of_ids(rows, multi.select(F.col("rep").alias("doc_id")).distinct(), "left_semi")), "sets")
    star = stored(linked(multi, sets), "links")
    labels = components(star)
    members = multi.drop("n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    more = stored(cross_links(members.join(several, "key", "left_semi"), sets, reps), "links")
    texts = real.join(classes, "set_hash").select("doc_id", "rep")
    shared_ids = texts.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    same = stored(texts.join(shared_ids, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "links")
    if not (more.isEmpty() and same.isEmpty()):
        labels = components(star.union(more).union(same))
    for used in (reps, multi, sets, star, more):
        dropped(used)
    out = sig.join(classes, "set_hash", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the least id. Rows with null ids stay."""
    found = stored(near_duplicates(docs, "doc_id", text_col), "near")
    return of_ids(docs, found.where(~F.col("kept")).select("doc_id").distinct(), "left_anti")


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.node WHERE reach.low < link.b),
least AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.low AS component_id, d.doc_id = least.low AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.node = d.doc_id
"""
