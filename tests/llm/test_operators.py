"""Each operator against brute force, the library that it must equal, or hand-made cases: nulls, empty and long texts,
ties, repeated rows, empty tables, and extra columns with names that the operators use themselves."""

import collections
import functools
import hashlib
import math
import random
import struct
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rosterly.llm import byte_bpe, decontamination, lm_scoring, near_dedup, pii_surrogates, quality_rules, secret_scan, sharding, substring_dedup, token_counts

WORDS = ["the", "of", "and", "sun", "moon", "river", "stone", "green", "walk", "slow", "bird", "añil", "straße", "x1"]


def corpus(seed: int = 3, n: int = 60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 160))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    long = " ".join(rng.choice(WORDS) for _ in range(6000))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, long), (n + 4, long + " end"), (n + 5, "one two"), (n + 6, "one  two"), (n + 6, "one  two"), (None, rows[0][1]), (n + 7, "nul \x00 \x1c \x85 　 ▁a ▁▁ <s> don't ①")]


def frame(spark, rows):
    """doc_id and text among columns whose names the operators use for their own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "found", "th", "h", "kept", "row", "rep", "key", "value", "label", "n_tokens", "_put", "copy", "starts", "slot", "source"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return collections.Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in docs)
    assert rows_of(token_counts.count_tokens(frame(spark, docs), P.path("piece_bpe_32k.model"))) == want
    assert rows_of(token_counts.count_tokens(frame(spark, docs), P.path("piece_bpe_32k.model"), table_size=3, cache_size=2)) == want


def test_token_counts_of_a_json_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = docs[:8]
    assert rows_of(token_counts.count_tokens(frame(spark, some), P.path("byte_bpe_50k.json")).select("doc_id", "n_tokens")) == collections.Counter((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in some)


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.encode_decode(frame(spark, docs), path, P.PATTERN).collect()
    want = collections.Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in docs)
    assert collections.Counter((r.doc_id, struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in got) == want
    assert collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == collections.Counter((i, t or "") for i, t in docs)


def test_shards_by_brute_force(spark):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.lookup_table(names, 251)
    lists = [[(sharding._hash(f"offset:{s}") + k * (sharding._hash(f"step:{s}") % 250 + 1)) % 251 for k in range(251)] for s in names]
    table, turn = [-1] * 251, 0
    while -1 in table:
        i = turn % 7
        table[next(x for x in lists[i] if table[x] < 0)] = i
        turn += 1
    assert owner == table and max(collections.Counter(owner).values()) - min(collections.Counter(owner).values()) <= 1
    got = sharding.place(frame(spark, [(5, "a"), (None, "b"), (5, "c")]), "doc_id", names, 251).collect()
    for r in got:
        assert r.slot == int(hashlib.sha256(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:15], 16) % 251 and r.shard == names[owner[r.slot]]
    fewer = sharding.lookup_table(names[:-1], 251)
    assert sum(a != b for a, b in zip(owner, fewer)) < 251 * 0.45
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 250)


def brute_hits(docs, items, window):
    out = []
    for i, t in docs:
        w = decontamination.item_words(t)
        hit, names = set(), set()
        for name, x in items:
            iw = decontamination.item_words(x)
            k = min(window, len(iw))
            wins = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if k else set()
            for s in range(len(w) - k + 1) if k else ():
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    names.add(str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination_by_brute_force(spark, docs, block_words):
    items = [(1, docs[0][1]), (2, "ONE, two!"), (3, None), (4, "..."), (5, " ".join(docs[5][1].split()[-12:])), (10, docs[0][1]), (6, "nowhere at all to be found in any of those texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_matches(frame(spark, docs), bench, block_words=block_words)
    got = rows_of(decontamination.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    want = brute_hits(docs, items, 10)
    assert got == want
    clean = decontamination.decontaminated(frame(spark, docs), bench)
    assert clean.columns == frame(spark, docs).columns
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter({r[0]: n for r, n in want.items() if not r[5]})


def brute_longest(docs, items, window):
    """Words, place and item of each document's longest verbatim match that holds a window."""
    out = []
    for i, t in docs:
        w, best = decontamination.item_words(t), (0, 0, "")
        for name, x in items:
            iw = decontamination.item_words(x)
            for s in range(len(w)):
                for q in range(len(iw)):
                    n = 0
                    while s + n < len(w) and q + n < len(iw) and w[s + n] == iw[q + n]:
                        n += 1
                    if n >= min(window, len(iw)):
                        best = min(best, (-n, s, str(name)))
        out.append((i, *((-best[0], best[2], best[1]) if best[0] else (None, None, None))))
    return collections.Counter(out)


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_longest_matches_by_brute_force(spark, docs, block_words):
    some = [(i, " ".join((t or "").split()[:120])) for i, t in docs[::3]]
    items = [(1, some[0][1]), (2, "one two"), (7, " ".join(some[4][1].split()[3:40])), (6, " ".join(some[4][1].split()[3:40])), (9, "sun " * 30), (3, None)]
    some += [(500, "sun " * 25 + "moon " + "sun " * 12), (501, "a sun sun sun b"), (502, some[4][1] + " x " + some[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.find_matches(frame(spark, some), bench, block_words=block_words))
    assert rows_of(got.select("doc_id", "longest_words", "longest_item", "longest_at")) == brute_longest(some, items, 10)
    assert rows_of(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_hits(some, items, 10)


def test_suffix_shards_agree_with_one(docs):
    import numpy as np

    probes = decontamination.Probes([("a", decontamination.item_words(docs[0][1])), ("b", [b"one", b"two"])], 10)
    seqs = [np.array([probes.ids.get(w, 0) for w in decontamination.item_words(t)], np.uint32) for _, t in docs]
    whole = sorted(zip(*(x.tolist() for x in decontamination.search(seqs, probes))))
    assert whole and whole == sorted(zip(*(x.tolist() for x in decontamination.search(seqs, probes, shard_bytes=4 * 10 * 5))))
    assert np.all(probes.length >= 2)


def test_a_very_long_item_takes_memory_in_proportion():
    import tracemalloc

    import numpy as np

    rng = random.Random(2)
    item = [str(rng.randrange(3000)).encode() for _ in range(20_000)]
    tracemalloc.start()
    for words in (item, [b"the"] * 20_000):
        probes = decontamination.Probes([("long", words), ("b", words[:50])], 10)
        seqs = [np.array([probes.ids.get(w, 0) for w in words[500:19_000]], np.uint32)]
        doc, start, probe = decontamination.search(seqs, probes)
        assert len(start) == 18_491
        got = decontamination._found(18_500, seqs[0], probes, start, probe, {"starts": [], "ends": [], "items": [], "longest_words": None, "longest_at": None, "longest_item": None})
        assert (got["starts"], got["ends"], got["longest_words"], got["longest_at"], got["longest_item"]) == ([0], [18_500], 18_500, 0, "long")
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def brute_repeats(docs, k):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for s in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - k + 1) if i is not None and first[tuple(w[s : s + k])] < i for p in range(s, s + k)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize(("k", "first"), [(50, 25), (7, 25), (50, 3), (21, 1)])
def test_substring_dedup_by_brute_force(spark, docs, k, first):
    assert rows_of(substring_dedup.without_repeats(frame(spark, docs), k, first=first)) == brute_repeats(docs, k)


def test_substring_dedup_levels_end_where_nothing_survives(spark):
    assert substring_dedup.lengths_of(50) == [13, 25, 50] and substring_dedup.lengths_of(400) == [13, 25, 50, 100, 200, 400] and substring_dedup.lengths_of(7, 1) == [1, 2, 4, 7] and substring_dedup.lengths_of(2) == [1, 2]
    word = lambda i, k: f"w{i}x{k}"
    shared = " ".join(word("s", k) for k in range(6))
    # runs of 6 words are common, no run of 12 or more is
    rows = [(i, f"{' '.join(word(i, k) for k in range(20))} {shared} {' '.join(word(i, k) for k in range(20, 40))}") for i in range(4)]
    assert rows_of(substring_dedup.without_repeats(frame(spark, rows), 40, first=5)) == brute_repeats(rows, 40)
    # a passage of 45 words that is common to all, with windows that reach over its ends
    passage = " ".join(word("p", k) for k in range(45))
    rows = [(i, f"{' '.join(word(i, k) for k in range(20))} {passage} {' '.join(word(i, k) for k in range(20, 40))}") for i in range(4)]
    for first in (2, 5, 20):
        assert rows_of(substring_dedup.without_repeats(frame(spark, rows), 40, first=first)) == brute_repeats(rows, 40)


def brute_groups(docs):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    ids = {i for i, _ in sets if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return collections.Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def test_near_duplicates_by_brute_force(spark, docs):
    df = frame(spark, docs)
    want = brute_groups(docs)
    assert rows_of(near_dedup.near_duplicates(df)) == want
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[3]}


def test_a_chain_of_near_duplicates_without_a_common_head(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 12 : k * 12 + 200])) for k in range(14)]  # neighbours are similar, ends are not
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {r[2] for r in brute_groups(rows)} == {87}


def test_one_id_with_two_texts_links_both(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (5, a), (5, b)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (5, 1)}


def test_blocks_of_a_bucket_find_what_one_block_finds(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    assert rows_of(near_dedup.near_duplicates(frame(spark, docs))) == brute_groups(docs)


def test_strays_of_a_hot_bucket_are_compared_with_all_members(spark, monkeypatch):
    """One large component and strays that share its bucket, in blocks smaller than the bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 120)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[:40] + [f"x{k}"])) for k in range(40)] + [(100, " ".join(words[8:48])), (101, " ".join(words[16:56])), (102, " ".join(words[20:60])), (103, "other words that nothing shares with")]
    assert rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)
    sets = {i: near_dedup.shingles(t, near_dedup.WordHashes()) for i, t in rows}
    key = [(i, s.tobytes(), near_dedup.Circulant().bands(s).tobytes(), len(s)) for i, s in sets.items()]
    frame_ = spark.createDataFrame(key, "rep long, shingles binary, bands binary, n_shingles long")
    members = frame_.select(F.lit(1).cast("bigint").alias("key"), F.lit(0).alias("band"), "rep", "n_shingles", F.when(F.col("rep") < 40, 0).otherwise(F.col("rep")).cast("bigint").alias("label"))
    links = {tuple(r) for r in near_dedup.cross_links(members, frame_.select(F.col("rep").alias("id"), "shingles"), frame_.select("rep", "bands")).collect()}
    assert links and all(near_dedup.similar(sets[a], sets[b]) for a, b in links)
    root = {i: 0 if i < 40 else i for i in sets}
    for a, b in sorted(links):
        root = {i: root[a] if r == root[b] else r for i, r in root.items()}
    want = {i: c for i, _, c, _ in brute_groups(rows)}
    assert all((root[i] == root[j]) == (want[i] == want[j]) for i in sets for j in sets)


def test_recall_of_bands_on_sets_at_the_threshold():
    """Share of pairs with a similarity just at 0.75 that meet in a bucket, of 4,000; and none at 0.2 more often than chance."""
    import numpy as np

    rng, c = np.random.default_rng(6), near_dedup.Circulant()
    meet = 0
    for _ in range(4000):
        n = int(rng.integers(1, 60)) * 7
        both, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (6 * n // 7, n - 6 * n // 7, n - 6 * n // 7))
        a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        assert near_dedup.similar(a, b)
        meet += bool((c.bands(a) == c.bands(b)).any()) if len(a) > near_dedup.MAX_EQUAL_ONLY else True
    assert meet >= 3996
    far = 0
    for _ in range(2000):
        both, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (20, 40, 40))
        far += bool((c.bands(np.concatenate([both, one])) == c.bands(np.concatenate([both, two]))).any())
    assert far < 2000 * 3 * 32 * 0.2**4


def test_small_sets_are_linked_with_equal_ones_alone(spark):
    assert near_dedup.MAX_EQUAL_ONLY == 2
    rows = [(i, t) for i, t in enumerate(["a b c", "A b  c", "a b d", "a b c d e f", "a b c d e f", "b c d e f g", "a b c d e f g", "a b c d e f g h", "x a b c d e f g", "a b c d e f g h a b c d e f g h"])]
    assert rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)


def test_lm_scores(spark, docs):
    own = [d for d in docs if d[0] is not None]
    df = spark.createDataFrame(own, "doc_id long, text string")
    rows = lm_scoring.score(df, df.where(~lm_scoring.held_out(F.col("doc_id"))), words=20).collect()
    token = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(x for i, t in own if not held(i) for x in token(t))
    n, v, text = sum(c.values()), len(c), dict(own)
    for r in rows:
        w = token(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    size = sum(len((text[r.doc_id] or "").encode()) + 1 for r in rows if r.held_out)
    assert -sum(r.score for r in rows if r.held_out) / size / math.log10(2) < 3.5  # bits a byte
    assert len(rows) == len(own)


def brute_tree(texts, depth):
    """log10 probability of a byte after a context by the definition, with dictionaries of nodes."""
    end = b"\xff"
    seen = collections.Counter()
    for t in texts:
        data = end * depth + t + end
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    seen[data[p - d : p], (256 + data[p]) >> (8 - k), data[p] >> (7 - k) & 1] += 1
    children = collections.defaultdict(set)
    for c, j, _ in seen:
        if c:
            children[c[1:], j].add(c)

    def block(c, j):
        a, b = seen[c, j, 0], seen[c, j, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def coded(c, j):
        if len(c) == depth:
            return block(c, j)
        own, below = block(c, j), sum(coded(x, j) for x in children[c, j])
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def chance(full, d, j):
        c = full[len(full) - d :]
        a, b = seen[c, j, 0], seen[c, j, 1]
        if a + b == 0:
            return 0.5
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(block(c, j) - math.log(2) - coded(c, j))
        return w * own + (1 - w) * chance(full, d + 1, j)

    def score(text):
        data, total = end * depth + text + end, 0.0
        for p in range(depth, len(data)):
            for k in range(8):
                one = chance(data[p - depth : p], 0, (256 + data[p]) >> (8 - k))
                total += math.log10(one if data[p] >> (7 - k) & 1 else 1 - one)
        return total

    return score


@pytest.mark.parametrize("depth, hot", [(5, 3), (2, 4_000_000), (0, 0)])
def test_lm_scores_equal_a_brute_force_tree(spark, depth, hot):
    rng = random.Random(depth)
    train = ["", None, "ABC abc", "the tha thé"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    others = ["zebra Ж", "the", None, "sun moon 木 river", "q" * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(train + others)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, docs.where(F.col("doc_id") < len(train)), depth=depth, hot=hot).collect()}
    lower = lambda t: (t or "").encode().lower()
    want = brute_tree([lower(t) for t in train], depth)
    for i, t in enumerate(train + others):
        assert math.isclose(got[i].score, want(lower(t)), rel_tol=1e-9), t
        assert math.isclose(got[i].bits_per_byte, -want(lower(t)) / math.log10(2) / (len(lower(t)) + 1), rel_tol=1e-9)


def test_lm_probabilities_of_all_bytes_sum_to_one(spark):
    grams = spark.createDataFrame([(ctx << 8 | s, n) for ctx, s, n in [(0x6161, 98, 5), (0x6161, 99, 2), (0x6261, 97, 7), (0xFFFF, 97, 1), (0x61FF, 98, 3)]], "key long, n long")
    nodes = lm_scoring.tree(grams, 2)
    values = {r.key: r.value for r in lm_scoring.seen_values(grams, nodes).collect()}
    for ctx in (0x6161, 0x6261, 0x7A61, 0x7A7A):
        keys = spark.range(256).select((F.col("id") + (ctx << 8)).alias("key"))
        rest = {r.key: r.value for r in lm_scoring.unseen_values(keys.join(grams, "key", "left_anti"), nodes).collect()}
        assert math.isclose(sum(10 ** {**values, **rest}[ctx << 8 | s] for s in range(256)), 1, rel_tol=1e-9)


def test_lookup_finds_keys_and_no_others():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    ask = np.concatenate([keys, keys + 1])
    got = lm_scoring.Lookup(keys).rows(ask)
    where = {int(k): i for i, k in enumerate(keys)}
    assert got.tolist() == [where.get(int(k), -1) for k in ask]


def test_lm_without_training_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(df, df.where("false")).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and math.isclose(got[1].score, -3 * math.log10(256), rel_tol=1e-6)


def test_quality_edge_cases(spark, docs):
    got = {r.doc_id: r for r in quality_rules.ledger(frame(spark, [(1, None), (2, "a b c a b c x"), (3, "l 1\n\nl 1\nl 1\n \n"), (4, "#*" + "é " * 60)])).collect()}
    assert (got[1].n_words, got[1].failed & 1, got[2].n_repeat_words, got[3].n_dup_lines, got[4].n_symbols, got[4].word_chars) == (0, 1, 6, 2, 2, 62)
    for i, t in docs[:40]:
        w = t.split()
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {p for s in range(len(w) - 2) if c[tuple(w[s : s + 3])] > 1 for p in range(s, s + 3)}
        assert i is not None and (len(cover),) == tuple(spark.range(1).select(quality_rules.measured(F.lit(t))["n_repeat_words"]).first()) if i % 10 == 0 else True
    book = quality_rules.ledger(frame(spark, docs))
    per = {r.rule: r for r in quality_rules.ablation(book).collect()}
    rows = book.collect()
    for rule, (bit, _) in quality_rules.RULES.items():
        assert (per[rule].n_failed, per[rule].n_alone) == (sum(r.failed >> bit & 1 for r in rows), sum(r.failed == 1 << bit for r in rows))
    kept = quality_rules.accepted(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns and kept.count() == sum(r.failed == 0 for r in rows)


def test_surrogates(spark):
    text = "Mail Ab.Cd.42@Mail8.example.com or ab.cd.42@mail8.example.com; +1 (988) 555-2485, +1-988-555-2485; 4041894974608795 and 4041-8949-7460-8795; not a card 9807915762804490; Mrs Anna Berg, Dr Anna Berg, Mr John Smith, Госпожа Анна Иванова; 1.2.3.4"
    rows = [(1, text), (2, "again ab.cd.42@mail8.example.com x"), (2, "again ab.cd.42@mail8.example.com x"), (3, None), (4, ""), (5, "clean, 12 of 2024."), (None, text)]
    got = pii_surrogates.anonymised(frame(spark, rows), "k").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[3].text is None and by[4].text == "" and by[5].text == "clean, 12 of 2024." and by[None].text == by[1].text
    t = by[1].text
    assert "9807915762804490" in t and by[1].pii_mentions == 11 and by[1].pii_kinds == ["card", "email", "ipv4", "person", "phone"]
    for real in ("example.com", "Anna", "Berg", "Smith", "Иванова", "4041894974608795", "555-2485", "1.2.3.4"):
        assert real not in t
    a, b = t.split("Mail ")[1].split(";")[0].split(" or ")
    assert a.lower() == b and a[0].isupper() and by[2].text.split()[1] == b
    p, q = (x.strip() for x in t.split(";")[1].split(","))
    assert p.replace("(", "").replace(")", "").replace(" ", "-") == q and p.startswith("+1 (")
    c, d = t.split(";")[2].strip().split(" and ")
    assert c == d.replace("-", "") and c[0] == "4" and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(c))) % 10 == 0
    names = [x.strip() for x in t.split(";")[4].split(",")]
    assert names[0].split(" ", 1)[1] == names[1].split(" ", 1)[1] and names[0].split()[1].endswith("na") and names[2].split()[1].endswith("n")
    assert pii_surrogates.anonymised(frame(spark, rows).where("false"), "k").count() == 0


def test_surrogates_stay_distinct_when_draws_collide(spark):
    rows = [("ssn", f"{i:09d}") for i in range(300)] + [("other", str(i)) for i in range(100, 400)]
    got = pii_surrogates.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    real = set(rows)
    made = {(r.kind, r.surrogate) for r in got}
    assert len(made) == len(got) == 600 and not made & real


def test_surrogates_give_up_loudly(spark):
    with pytest.raises(ValueError):
        pii_surrogates.surrogates(spark.createDataFrame([("phone", f"1{i}") for i in range(10)], "kind string, entity string"), "k")


def test_secrets(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    filler = "the river and the stone walk slow of green moon "
    for i in range(60):
        h = digits(40)
        kind = i % 6
        body, secret = {0: (f'token = "{h}"', h), 1: (f"password={h[:18]}", h[:18]), 2: ("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), None), 3: ("unbelievablynaturalwordwithoutend", ""), 4: (f"commit {h}", ""), 5: ("password=changeme1234", "")}[kind]
        rows.append((i, filler + body + " " + filler))
        want[i] = body if secret is None else secret
    rows += [(100, None), (101, ""), (None, rows[0][1]), (1, rows[1][1])]
    got = secret_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want.get(0 if r.doc_id is None else r.doc_id, "")
        assert r.secrets == ([expected] if expected else []), r
    kept = secret_scan.without_secrets(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, s in want.items() if not s] + [100, 101])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for out in (token_counts.count_tokens(none, P.path("piece_bpe_32k.model")), byte_bpe.encode_digest(none, path, P.PATTERN), decontamination.digest(decontamination.find_matches(none, bench)), sharding.place(none, "doc_id", ["a"], 7), near_dedup.near_duplicates(none), near_dedup.deduplicated(none), substring_dedup.without_repeats(none), quality_rules.ledger(none), secret_scan.scan(none), secret_scan.without_secrets(none), lm_scoring.score(none, none)):
        assert out.count() == 0


def test_an_empty_benchmark_hits_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.digest(decontamination.find_matches(frame(spark, docs), bench)).where("contaminated").count() == 0
