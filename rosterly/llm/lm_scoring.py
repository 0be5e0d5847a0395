"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions. For every context of 0 to DEPTH preceding bytes and every place in a byte, the
tree holds how often each decision was taken in training. A node mixes its own Krichevsky-Trofimov estimate with that
of its children, in equal prior shares, so the weight of each depth follows from how well it coded the training text.
A document's score is the log10 probability of its bytes and one end, with the tree as trained; its code length per
byte follows from it.

The tree holds every context seen in training and grows with the corpus. It is a table of its nodes for each depth:
1. One scan counts the (DEPTH + 1)-grams of all training documents.
2. From the deepest level up, nodes are summed by their parent: counts, and the log probability of the children's code.
   A sum has partial aggregation, so no group is ever in one task.
3. From the root down, each node joins its parent (which has at most 256 children) for what is left of the mixture.
4. Each gram seen in training gets one number, the log10 probability of its last byte after the others.
Documents are scored in one scan with the HOT most frequent grams, which are broadcast (a fixed bound); all other grams
are joined with their numbers by a shuffle. A gram not seen in training takes, for each decision, the deepest node that
was; below that node nothing is known, and an empty node's estimate is a half.

The word baseline looks up each token's training count: words that hold at least one part in WORDS of all tokens are
broadcast (so at most WORDS of them), other tokens are joined with the counts by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, dropped, stored, table, trimmed
from .hashing import WordHashes

DEPTH = 5
#: Grams and words that are broadcast at most (12 and 16 bytes each); the others are joined.
HOT, WORDS = 4_000_000, 4_000_000
#: No UTF-8 text holds this byte: it ends a text and stands before it.
END = 255
#: Bytes handled at a time, and distinct n-grams or words held before they are handed on.
CHUNK, HELD = 1 << 20, 500_000
FOLDS = 10
_END_WORD = b"\n"  # no word is a line break


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def pieces(texts, depth: int = DEPTH):
    """Groups of (owners, lengths, keys): for each text or part of one, the (depth + 1)-grams that end at its bytes."""
    owner, parts, size = [], [], 0
    for i, text in enumerate(texts):
        data = bytes([END]) * depth + text + bytes([END])
        for at in range(0, len(data) - depth, CHUNK):
            part = data[at : at + CHUNK + depth]
            owner.append(i)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield _grams(owner, parts, depth)
                owner, parts, size = [], [], 0
    if parts:
        yield _grams(owner, parts, depth)


def _grams(owner, parts, depth):
    a = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) - depth for p in parts])
    key = np.zeros(len(a) - depth, np.int64)
    for k in range(depth + 1):
        key = key << 8 | a[k : len(a) - depth + k]
    first = np.cumsum(lengths + depth) - lengths - depth
    place = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    return owner, lengths, key[place]


def corpus_counts(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) over all training texts: kind 0 has words by their hash, kind 1 (depth + 1)-grams."""
    shared = Shared(train.sparkSession, 1)

    def rows(kind, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

    def merged(parts):
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    @trimmed
    def run(batches):
        hashes = shared.get(lambda _: WordHashes())
        words, grams, held = Counter(), [], 0

        def word_rows():
            return rows(0, np.fromiter((hashes[w] for w in words), np.uint64, len(words)).view(np.int64), np.fromiter(words.values(), np.int64, len(words)))

        for b in batches:
            for at in range(0, len(b), 1000):
                texts = [(t.as_py() or "").encode().lower() for t in b.column("text").slice(at, 1000)]
                for t in texts:
                    words.update(t.split())
                    words[_END_WORD] += 1
                    if len(words) > HELD:
                        yield word_rows()
                        words = Counter()
                for _, _, key in pieces(texts, depth):
                    grams.append(np.unique(key, return_counts=True))
                    held += len(grams[-1][0])
                    if held > 2 * HELD:
                        grams = [merged(grams)]
                        held = len(grams[0][0])
                        if held > HELD:
                            yield rows(1, *grams[0])
                            grams, held = [], 0
        yield word_rows()
        if grams:
            yield rows(1, *merged(grams))

    return train.select("text").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: Column) -> Column:
    """The natural logarithm of the gamma function for x >= 0.5: Stirling's series at x + 8 and the recurrence."""
    x = x.cast("double")
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def block(zero: Column, one: Column) -> Column:
    """The log of the Krichevsky-Trofimov probability of a node's decisions."""
    return log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - math.log(math.pi)


def _path(symbol: Column) -> Column:
    """The eight (node, bit) of a byte: node 1 is the first decision, nodes 2j and 2j + 1 follow node j."""
    steps = lambda k: F.struct(F.shiftright(symbol + 256, 8 - k).cast("int").alias("node"), F.shiftright(symbol, 7 - k).bitwiseAND(F.lit(1)).cast("int").alias("bit"))
    return F.array(*(steps(k) for k in range(8)))


def _context(key: Column, d: int) -> Column:
    """The d bytes before the last one of a gram."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * d) - 1))


def tree(grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth the nodes (ctx, node, q) of all contexts seen. q: the probability that the next decision is one,
    where this is the deepest node that training saw. grams: key (of depth + 1 bytes), n."""
    last = grams.select(_context(F.col("key"), depth).alias("ctx"), F.explode(_path(F.col("key").bitwiseAND(F.lit(255)))).alias("p"), "n")
    count = lambda bit: F.sum(F.when(F.col("p.bit") == bit, F.col("n")).otherwise(0)).alias(f"n{bit}")
    counts = last.groupBy("ctx", F.col("p.node").alias("node")).agg(count(0), count(1))
    levels = [stored(counts.withColumn("coded", block(F.col("n0"), F.col("n1"))), "level")]
    for d in range(depth - 1, -1, -1):
        up = levels[0].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("coded").alias("below"))
        both = up.withColumn("own", block(F.col("n0"), F.col("n1")))
        most = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2)
        levels.insert(0, stored(both.withColumn("coded", most).withColumn("weight", F.exp(F.col("own") - math.log(2) - F.col("coded"))).select("ctx", "node", "n0", "n1", "coded", "weight"), "level"))
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    out, up = [], None
    for d, level in enumerate(levels):
        own = level.withColumn("estimate", estimate)
        if up is None:
            own = own.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0)})
        else:
            own = own.withColumn("parent", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(up, ["parent", "node"])
        if d == depth:
            done = stored(own.select("ctx", "node", (F.col("so_far") + F.col("left") * F.col("estimate")).alias("q")), "nodes")
        else:
            then = own.select("ctx", "node", (F.col("so_far") + F.col("left") * F.col("weight") * F.col("estimate")).alias("so_far"), (F.col("left") * (1 - F.col("weight"))).alias("left"))
            done = stored(then.withColumn("q", F.col("so_far") + F.col("left") * 0.5), "nodes")
            up = done.select(F.col("ctx").alias("parent"), "node", "so_far", "left")
        out.append(done.select("ctx", "node", "q"))
    for level in levels:
        dropped(level)
    return out


def _coded(q: Column, bit: Column) -> Column:
    return F.log10(F.when(bit == 1, q).otherwise(1 - q))


def seen_values(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(key, n, value) of grams seen in training: all their nodes are at the deepest level. A context has at most 255
    nodes, which are gathered in one map."""
    depth = len(nodes) - 1
    own = nodes[depth].groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("node", "q"))).alias("q"))
    each = F.transform(_path(F.col("key").bitwiseAND(F.lit(255))), lambda p: _coded(F.element_at("q", p["node"]), p["bit"]))
    return grams.withColumn("ctx", _context(F.col("key"), depth)).join(own, "ctx").select("key", "n", F.aggregate(each, F.lit(0.0), lambda a, x: a + x).alias("value"))


def unseen_values(keys: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(key, value) of distinct grams that training did not see. The nodes of depths 0 and 1, at most 257 * 255, are
    broadcast; those of other depths are joined at once and the deepest one is taken."""
    depth = len(nodes) - 1
    each = keys.select("key", F.explode(_path(F.col("key").bitwiseAND(F.lit(255)))).alias("p")).select("key", "p.node", "p.bit")
    for d in range(min(depth, 1) + 1):
        each = each.withColumn("ctx", _context(F.col("key"), d)).join(F.broadcast(nodes[d].withColumnRenamed("q", f"q{d}")), ["ctx", "node"], "left").drop("ctx")
    q = F.coalesce(*(F.col(f"q{d}") for d in range(min(depth, 1), -1, -1)), F.lit(0.5))
    each = each.select("key", "node", "bit", q.alias("q"))
    if depth > 1:
        levels = F.array(*(F.struct(F.lit(d).alias("d"), _context(F.col("key"), d).alias("ctx")) for d in range(2, depth + 1)))
        asked = each.select("key", "node", F.explode(levels).alias("l")).select("key", "node", "l.d", "l.ctx")
        every = reduce(DataFrame.unionByName, (nodes[d].withColumn("d", F.lit(d)) for d in range(2, depth + 1)))
        deepest = asked.join(every, ["d", "ctx", "node"]).groupBy("key", "node").agg(F.max_by("q", "d").alias("deep"))
        each = each.join(deepest, ["key", "node"], "left").withColumn("q", F.coalesce("deep", "q"))
    return each.groupBy("key").agg(F.sum(_coded(F.col("q"), F.col("bit"))).alias("value"))


def frequent(values: DataFrame, most: int) -> DataFrame:
    """The most frequent rows, `most` of them at most: those with the counts of the highest classes that fit, where a
    class holds the counts between two steps of a sixteenth of a power of two."""
    kind = F.floor(F.log2("n") * 16)
    fits, least = 0, None
    for r in values.groupBy(kind.alias("kind")).agg(F.count("*").alias("rows")).orderBy(F.desc("kind")).collect():
        fits += r.rows
        if fits > most:
            break
        least = r.kind
    return values.where(F.lit(False) if least is None else kind >= least)


class Lookup:
    """Rows of sorted distinct keys, by two tables of slots and, for the few keys that have a place in neither, by
    binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        todo = np.arange(len(keys), dtype=np.int32)
        bits = max(10, int(len(keys)).bit_length() + 1)
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            slot = np.full(1 << bits, -1, np.int32)
            at = self._slot(keys[todo], factor, bits)
            slot[at] = todo
            self.tables.append((factor, bits, slot))
            todo = todo[slot[at] != todo]
        self.others = len(todo) > 0

    @staticmethod
    def _slot(keys, factor, bits):
        return (keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        factor, bits, slot = self.tables[0]
        out = slot[self._slot(keys, factor, bits)]
        other = np.flatnonzero(self.keys[out] != keys)  # -1, an empty slot: no such key
        if len(other):
            ask = other[out[other] >= 0]
            out[other] = -1
            factor, bits, slot = self.tables[1]
            row = slot[self._slot(keys[ask], factor, bits)]
            good = (row >= 0) & (self.keys[row] == keys[ask])
            out[ask[good]] = row[good]
            ask = ask[~good & (row >= 0)]
            if self.others and len(ask):
                at = np.minimum(np.searchsorted(self.keys, keys[ask]), len(self.keys) - 1)
                good = self.keys[at] == keys[ask]
                out[ask[good]] = at[good]
        return out


class Scorer:
    def __init__(self, value):
        self.depth, grams, values, hot, count, n, v = value
        self.hashes, self.look, self.look_words = WordHashes(), Lookup(grams), Lookup(hot)
        self.values = np.append(values, 0.0)  # the last stands for keys that the table lacks
        self.logs = np.append(np.log10((count + 0.1) / (n + 0.1 * (v + 1))) if n else count, 0.0)

    def scores(self, texts: list[bytes]):
        """What the broadcast grams add to each text's score; owner, key and count of all other grams."""
        out, others = np.zeros(len(texts)), []
        for owner, lengths, key in pieces(texts, self.depth):
            row = self.look.rows(key)
            np.add.at(out, owner, np.add.reduceat(self.values[row], np.cumsum(lengths) - lengths))
            rest = np.flatnonzero(row < 0)
            others.append(_counted(np.stack([np.repeat(np.array(owner), lengths)[rest], key[rest]])))
        return out, np.concatenate(others, axis=1) if others else np.zeros((3, 0), np.int64)

    def base(self, texts: list[bytes]):
        """For each text its tokens, those of broadcast words and their part of the score; hashes of all other tokens, and
        where those of each text begin."""
        parts = []
        for text in texts:
            ws = text.split()
            ws.append(_END_WORD)
            parts.append(self.hashes.of(ws))
        n = np.array([len(x) for x in parts])
        h = np.concatenate(parts).view(np.int64)
        row, first = self.look_words.rows(h), np.cumsum(n) - n
        hit = row >= 0
        known = np.add.reduceat(hit.astype(np.int64), first)
        return n, known, np.add.reduceat(self.logs[row], first), h[~hit], np.concatenate([[0], np.cumsum(n - known)]).astype(np.int32)


def _counted(pair: np.ndarray) -> np.ndarray:
    """Rows owner, key and count of the distinct columns of pair."""
    order = np.lexsort((pair[1], pair[0]))
    pair = pair[:, order]
    first = np.flatnonzero(np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)]) if pair.shape[1] else np.zeros(0, np.int64)
    return np.vstack([pair[:, first], np.diff(np.r_[first, pair.shape[1]])])


def score(docs: DataFrame, train: DataFrame, depth: int = DEPTH, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (the code length of the
    text and its end, over their bytes) of each row of docs, learnt from train (both: doc_id, text). A-Z are
    lower-cased. depth: 0 to 6.

    A null or empty text is the end alone. A null id counts as the empty text when folds are dealt. Repeated rows each
    give a row. Without training texts all bytes are equally likely and no token is known. Other columns are ignored.
    hot and words bound what is broadcast and change no result.
    """
    spark = docs.sparkSession
    counts = stored(corpus_counts(train, depth), "counts")
    tokens, grams = counts.where("kind = 0"), counts.where("kind = 1").select("key", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = tokens.where(F.col("n") * words >= n).select("key", "n").orderBy("key").toArrow()
    nodes = tree(grams, depth)
    values = stored(seen_values(grams, nodes), "values")
    some = frequent(values, hot).select("key", "value").toArrow()
    key, value = some.column("key").to_numpy(), some.column("value").to_numpy()
    order = np.argsort(key)
    shared = Shared(spark, (depth, key[order], value[order], often.column("key").to_numpy(), often.column("n").to_numpy(), n, v))

    @trimmed
    def run(batches):
        s = shared.get(Scorer)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                texts = [(t.as_py() or "").encode().lower() for t in part.column("text")]
                n_tokens, n_known, base, rare, from_ = s.base(texts)
                total, (owner, other, times) = s.scores(texts)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(total, pa.float64()), lists(from_, rare), lists(ends, other), lists(ends, times)], names=["doc_id", "held_out", "size", "n_tokens", "n_known", "base_score", "score", "rare", "grams", "times"])

    first = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, size bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, grams array<bigint>, times array<bigint>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    cold = tokens.where(F.col("n") * words < n).select("key", "n")
    part = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(n + 0.1 * (v + 1)))
    rare = first.select("row", F.explode("rare").alias("key")).join(cold, "key", "left").groupBy("row").agg(F.sum(part).alias("more"), F.count("n").alias("seen"))
    other = stored(first.where(F.size("grams") > 0).select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("key"), F.col("g.times").alias("times")), "grams")
    new = stored(other.select("key").distinct().join(values, "key", "left_anti"), "unseen")
    known = values.select("key", "value").unionByName(stored(unseen_values(new, nodes), "values"))
    rest = other.join(known, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest"))
    for level in nodes:
        dropped(level)
    out = first.drop("rare", "grams", "times").join(rare, "row", "left").join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("size")).alias("bits_per_byte"),
    )


def op3_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, docs.where(~held_out(F.col("doc_id"))))
