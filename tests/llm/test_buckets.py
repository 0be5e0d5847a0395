"""op9 inside large buckets: parts of a star, candidates of strays by their rarest shingles."""

import numpy as np
import pytest

from rosterly.llm import near_dedup

from .test_operators import brute_groups, docs, frame, rows_of  # noqa: F401


@pytest.mark.parametrize("pairs", [1, 3])
def test_stars_in_parts_find_what_one_part_finds(spark, docs, monkeypatch, pairs):  # noqa: F811
    monkeypatch.setattr(near_dedup, "STAR_PAIRS", pairs)
    words = [f"w{i}" for i in range(60)]
    rows = docs + [(1000 + k, " ".join(words + [f"x{k}"])) for k in range(30)]
    assert rows_of(near_dedup.near_duplicates(frame(spark, rows))) == brute_groups(rows)


def test_similar_sets_share_an_entry_of_their_prefixes():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n = rng.integers(1, 40, 12)
        base = rng.permutation(60)
        sets = [np.sort(np.concatenate([base[: max(1, int(k * 0.85))], 60 + rng.permutation(40)[: k - max(1, int(k * 0.85))]])) for k in n]
        n = np.array([len(s) for s in sets])
        own, shingle, short = near_dedup.prefixes(np.concatenate(sets), n)
        long_, short_ = ([set(shingle[(own == k) & of]) for k in range(len(n))] for of in (True, short))
        assert all(p and p <= q <= set(s) for p, q, s in zip(short_, long_, sets))
        for i in range(len(n)):
            for j in range(i):
                small, large = (i, j) if n[i] <= n[j] else (j, i)
                assert short_[small] & long_[large] or not near_dedup.similar(sets[i].astype(np.uint64), sets[j].astype(np.uint64))


def test_pages_of_one_template_are_rarely_candidates():
    """Of 2,000 sets each two of which are 0.6 alike, prefixes bring nearly no two together."""
    n, base = 2_000, np.arange(150)
    sets = [np.concatenate([base, 150 + 50 * k + np.arange(50)]) for k in range(n)]
    own, shingle, short = near_dedup.prefixes(np.concatenate(sets), np.full(n, 200))
    met = near_dedup.Holders(shingle[short], own[short], int(shingle.max()) + 1).of(shingle)
    assert sum(map(len, met)) == short.sum(), "a set meets itself alone"
