"""What the near-copy join compares: it grows with the keys that texts share."""

from __future__ import annotations

import numpy as np
import pandas as pd

from gridloom.llm import components, ngram_jaccard
from gridloom.llm.textkit import shingle_sets

RULE = ngram_jaccard.Threshold(80, 100)


def test_texts_in_a_chain_meet_their_neighbours_only(spark, monkeypatch):
    """Each text shares shingles with the next few, so that one chain of candidates holds all
    texts; two texts that share no key aren't compared."""
    n, dealt, plain = 600, [], ngram_jaccard.materialize

    def noted(df, name):
        table = plain(df, name)
        if name == "jaccard-rows":
            dealt.append(sum(r["count"] ** 2 for r in table.groupBy("cluster").count().collect()))
        return table

    monkeypatch.setattr(ngram_jaccard, "materialize", noted)
    words = [f"w{i}" for i in range(n + 11)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(n)], "doc_id long, text string")
    found = ngram_jaccard.jaccard_components(docs, 5, 80, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i) for i in range(n)]
    assert 0 < sum(dealt) < 50 * n


def test_sketch_grows_with_the_shingles():
    assert ngram_jaccard.sketch_bits(0) == ngram_jaccard.sketch_bits(10**6) == ngram_jaccard.SKETCH_BITS
    for shingles in (10**8, 5 * 10**8, 10**9):
        assert ngram_jaccard.SLOT_LOAD / 2 <= shingles / 2 ** ngram_jaccard.sketch_bits(shingles) <= ngram_jaccard.SLOT_LOAD
    assert ngram_jaccard.sketch_bits(10**12) == ngram_jaccard.SLOT_BITS


def test_levels_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SLOTS_HELD", 500)
    texts = [" ".join(f"a{(i * j) % 97}" for j in range(60)) for i in range(1, 80)] + [None, ""]
    told = pd.concat(ngram_jaccard._light(3)(iter([pd.DataFrame({"doc_id": range(k, k + 9), "text": texts[k : k + 9]}) for k in range(0, 81, 9)])))
    sketches = spark.createDataFrame([(int(b), s) for b, s in zip(told["block"], told["slots"], strict=True) if s is not None], "block int, slots binary")
    seen = {ngram_jaccard.digest(s): s for s in shingle_sets(texts, 3) if len(s)}
    values = np.concatenate(list(seen.values()))
    for bits in (22, 24):
        counts = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        assert (ngram_jaccard.level_table(ngram_jaccard.shingle_levels(sketches, bits)) == np.frexp(counts.astype(float))[1]).all()


def test_packed_slots():
    for steps in ([0], [254, 255, 256, 0, 0, 510, 1000, 1], [255], [262143]):
        slots = np.cumsum(steps)
        assert ngram_jaccard.unpacked_slots(ngram_jaccard.packed_slots(slots)).tolist() == slots.tolist()


def test_members_are_told_with_their_key_over_any_batches():
    rows = pd.DataFrame({"key": [1, 2, 2, 2, 3, 3, 5, 5, 5, 9], "mark": [7, 4, 4, 6, 2, 2, 1, 3, 8, 1]})
    for size in (1, 2, 3, 10):
        told = pd.concat(ngram_jaccard._members(iter([rows[k : k + size].reset_index(drop=True) for k in range(0, 10, size)])))
        assert sorted(told.itertuples(index=False, name=None)) == [(2, 4, 4), (2, 6, 4), (5, 1, 1), (5, 3, 1), (5, 8, 1)]


def test_listed_pairs_are_those_of_tiles():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 700).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 + 10 * (i % 30)], rng.integers(0, 2**63, i % 7 * 15).astype(np.uint64)))) for i in range(50)]
    side, sizes, labels = rng.integers(0, 2, 50), np.array([len(s) for s in sets]), rng.integers(0, 9, 50)
    bits = [ngram_jaccard.bitmap(s, ngram_jaccard.SIGNATURE_BITS).tobytes() for s in sets]
    own = np.flatnonzero(side == 0)
    left, right = ngram_jaccard.sift_pairs(np.repeat(own, 50), np.tile(np.arange(50), len(own)), sizes, labels, bits, RULE)
    kept = np.zeros(50, dtype=bool)
    kept[left] = kept[right] = True
    assert 0 < len(left) < 50 * len(own)
    assert (kept == ngram_jaccard.sift_tile(side, sizes, labels, bits, RULE)).all()
    for i in own:
        for j in range(50):
            if labels[i] != labels[j] and RULE.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j]):
                assert ((left == i) & (right == j)).any()


def test_few_edges_have_the_components_of_many(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for edges in (rng.integers(-60, 60, (50, 2)).tolist(), [[i, i + 1] for i in range(40)], [[3, 3]], []):
        table = ngram_jaccard.materialize(spark.createDataFrame(edges, "u long, v long"), "edges")
        expected = sorted(tuple(r) for r in components.components(table).collect())
        assert sorted(tuple(r) for r in ngram_jaccard._joined(table, "few").collect()) == expected
        with monkeypatch.context() as m:
            m.setattr(ngram_jaccard, "FEW_EDGES", -1)
            assert sorted(tuple(r) for r in ngram_jaccard._joined(table, "many").collect()) == expected
