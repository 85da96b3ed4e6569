import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint)."""
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    fps = np.array([f for _, f in rows], np.uint64)
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3):
            a, b = root(k), root(int(j))
            label[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return {k: min((x for x in groups[root(k)] if x is not None), default=None) for k in range(len(rows))}


@given(st.text(alphabet="aAbBéÉ \t\n\x0b\x1c ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.booleans())
def test_trie_forest_links_as_all_pairs_do(seed, groups, sided):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 8, np.uint64)
    n = 120
    fp = rng.choice(base, n)
    for _ in range(4):
        fp ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n, np.uint64), np.uint64(0))
    key, side = rng.integers(0, groups, n), rng.integers(0, 2, n) if sided else np.zeros(n, np.int64)
    order = np.lexsort((fp, side, key))
    key, side, fp = key[order], side[order], fp[order]
    got = simhash.trie_forest(key, side, fp)
    forest = simhash.Forest(n)
    for a in range(n):
        two = len(set(side[key == key[a]])) == 2
        b = np.flatnonzero((key == key[a]) & ((side != side[a]) if two else (side == side[a])) & (np.bitwise_count(fp ^ fp[a]) <= 3))
        forest.link(np.full(len(b), a), b)
    assert (got == forest.roots(np.arange(n))).all()


@pytest.mark.parametrize("size", [4096, 8])
def test_components_equal_brute_force(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)  # 8: many groups are cut into slices
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in docs.collect()]
    want = brute_components(rows)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, f) in enumerate(rows):
        assert (got[i].component_id, got[i].fingerprint) == (want[k], f"{f:016x}")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_edge_rows(spark):
    rows = [(5, "a b c d", "x"), (3, "a b c d", "y"), (9, None, "z"), (8, "", "z"), (7, " \n", "z"), (5, "a b c d", "x"), (None, "a b c d", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
