"""Lexical search, the piece codec and importance resampling against brute force and the library."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import lexical_search, piece_codec, resampling

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score double, rank string, row int, ids array<int>"  # clashing names
WORDS = [f"w{i}" for i in range(60)] + ["the", "Énorme", "日本語", "x9"]


def _corpus(n=90, seed=1):
    rng, texts = np.random.default_rng(seed), []
    for i in range(n):
        texts.append(" ".join(rng.choice(WORDS, int(rng.integers(1, 80)), p=np.arange(1, 65)[::-1] / 2080)))
    texts += [None, "", " \n.,", texts[0], texts[0], "THE the,The", "the " * 30_000, "w1"]
    ids = [*range(n), 500, 501, 502, 0, 503, None, 504, None]
    return list(zip(ids, texts, strict=True))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", 1, [1]) for i, t in rows], DOCS)


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranking(rows, query, k):
    bags = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in rows if _terms(t)]
    total = sum(n for _, _, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for i, bag, n in bags:
        m = 50 + 50 * n * len(bags) // total
        score = sum(lexical_search.weigh(df[w], len(bags)) * (10**9 * bag[w] // (1000 * bag[w] + 20 * m)) for w in set(_terms(query)) if w in bag)
        if score > 0:
            out.append((-score, i is None, i))
    return [(i, -s) for s, _, i in sorted(out, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]


@pytest.mark.parametrize("k", [3, 50])
def test_ranks_documents(spark, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 13)
    monkeypatch.setattr(lexical_search, "STRETCH", 2)
    rows = _corpus()
    items = [(1, "w1 w2 the unseen"), (1, "w50, W51 w52 日本語"), (2, None), (3, "nothing here"), (None, "énorme Énorme the"), (4, " ".join(WORDS))]
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    found = lexical_search.rank_documents(_docs(spark, rows).repartition(3), asked, k).collect()
    want = sorted([(i, r + 1, d, s) for i, t in items for r, (d, s) in enumerate(_ranking(rows, t, k))], key=str)
    assert sorted([tuple(r) for r in found], key=str) == want


def test_search_in_several_passes_and_with_a_whole_index(spark, monkeypatch):
    rows = _corpus(40, 2)
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} the") for i in range(9)], "item_id long, text string")
    once = sorted(map(tuple, lexical_search.rank_documents(_docs(spark, rows), items, 4).collect()))
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 30)
    assert sorted(map(tuple, lexical_search.rank_documents(_docs(spark, rows), items, 4).collect())) == once
    terms = {bytes(t).decode() for r in lexical_search.build_shards(_docs(spark, rows)).collect() for t in r["terms"]}
    assert terms == {w for _, t in rows for w in _terms(t)}


def test_search_of_empty_tables(spark):
    none, items = _docs(spark, []), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.rank_documents(none, items).collect() == []
    assert lexical_search.rank_documents(_docs(spark, _corpus(3)), items.limit(0)).collect() == []


def test_blocks_have_the_least_error():
    rng = np.random.default_rng(4)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 17, 40, 3)]
    ends, maxima, upto = lexical_search.cut_blocks(np.concatenate(lists), np.cumsum([len(x) for x in lists]), longest=9, cost=60.0)
    start = 0
    for x, last in zip(lists, upto, strict=True):
        best = [0.0]
        for j in range(1, len(x) + 1):
            best.append(min(best[i] + (j - i) * int(x[i:j].max()) - int(x[i:j].sum()) + 60 for i in range(max(0, j - 9), j)))
        begin = int(ends[start - 1]) if start else 0
        assert ends[last - 1] - begin == len(x)
        cuts = [begin, *ends[start:last]]
        parts = [x[a - begin : b - begin] for a, b in zip(cuts, cuts[1:])]
        assert [p.max() for p in parts] == maxima[start:last].tolist()
        assert max(map(len, parts)) <= 9
        assert sum(len(p) * int(p.max()) - int(p.sum()) + 60 for p in parts) == best[-1]
        start = int(last)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(MODEL)


def _same(codec, text):
    ids = codec.library.encode(text)
    found = np.frombuffer(codec.ids_of(text), np.int32)
    assert found.tolist() == ids, text[:200]
    assert codec.text_of(found) == codec.library.decode(ids)


def test_codec_agrees_with_the_library(codec):
    rng = np.random.default_rng(7)
    for text in ["", " ", "     ", "a\n\n b", "▁▁▁x", "<s></s><0x41>", "x" * 1000, "日本語😀é̀", "\0\x01", "a  b   c    d", "².5", "_{\\", "Foo.bar,baz"]:
        _same(codec, text)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz ETAOIN  \n", "aab b  ", "0123456789.,;:()[]{}<>/\\_ ▁", "日本語ひらがな русский αβγ éè 😀👩‍👧 "):
        for n in rng.integers(1, 60, 300):
            _same(codec, "".join(rng.choice(list(alphabet), n)))
    pieces = [t.replace("▁", " ") for t in codec.ids]
    for n in rng.integers(1, 9, 600):
        _same(codec, "".join(rng.choice(pieces, n)))


def test_codec_forgets_and_stays_right(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "PAIRS", 20)
    monkeypatch.setattr(piece_codec, "WORDS", 5)
    for text in ("internationalization of tokenizers", "antidisestablishmentarianism", "the quick brown fox"):
        _same(codec, text)


def test_bytes_that_are_no_text_become_marks(codec):
    ids = [codec.byte[b] for b in (0xE6, 0x41, 0xFF, 0xE6, 0x97, 0xA5)] + codec.library.encode(" x") + [0, 1, 2]
    assert codec.text_of(np.array(ids, np.int32)) == codec.library.decode(ids)


def test_digests_of_documents(spark, codec):
    rows = [*_corpus(20), (7, "long " * 50_000), (8, "日" * 20_000)]
    found = piece_codec.digest_documents(_docs(spark, rows), MODEL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, codec.library.encode(t or "")) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted([(i, len(x), sha(",".join(map(str, x))), sha(codec.library.decode(x))) for i, x in ids], key=str)
    assert piece_codec.digest_documents(_docs(spark, []), MODEL).collect() == []


def _resampled(rows, target, percent, fewest):
    s, t = ([zlib.crc32(w.encode()) % 10000 for _, x in part for w in _terms(x)] for part in (rows, target))
    cs, ct = Counter(s), Counter(t)
    gain = [math.floor(1000 * math.log((ct[b] + 1) * (len(s) + 10000) / ((cs[b] + 1) * (len(t) + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(w.encode()) % 10000] for w in _terms(x))
        out.append([i, len(_terms(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted([r for r in out if r[1] >= fewest], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = rank + 1
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize(("percent", "fewest"), [(10, 20), (55, 1), (100, 0)])
def test_resamples(spark, percent, fewest):
    rows, target = _corpus(), [(1, "w1 w2 w3 the"), (2, None), (3, "日本語 the the")]
    found = resampling.resample(_docs(spark, rows).repartition(3), _docs(spark, target), percent, fewest).collect()
    assert sorted(str(tuple(r)) for r in found) == _resampled(rows, target, percent, fewest)


def test_resamples_empty_tables(spark):
    rows = _corpus(30)
    assert resampling.resample(_docs(spark, []), _docs(spark, rows)).collect() == []
    found = resampling.resample(_docs(spark, rows), _docs(spark, [])).collect()
    assert sorted(str(tuple(r)) for r in found) == _resampled(rows, [], 10, 20)


def test_draw_splits_rows_of_one_score_and_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 40)
    monkeypatch.setattr(resampling, "FAN_IN", 2)
    monkeypatch.setattr(resampling, "RUN_ROWS", 50)
    rows = [(i, 5 if i % 3 else None, 7) for i in range(900)] + [(900 + i, i, i % 9) for i in range(300)]
    scored = spark.createDataFrame(rows, "row long, doc_id long, score long").repartition(5).cache()
    order = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))
    found = resampling.draw_highest(scored, 700, len(rows))
    assert sorted((r["rank"], r["row"]) for r in found.collect()) == [(k + 1, r[0]) for k, r in enumerate(order[:700])]


def test_tournament_merges_more_runs_than_its_fan_in(monkeypatch):
    monkeypatch.setattr(resampling, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 5, (200, 4))
    rows = rows[np.lexsort(rows.T[::-1])]
    runs = [rows[i::11] for i in range(11)]
    for most in (0, 1, 57, 200, 999):
        assert resampling.merge(runs, most).tolist() == rows[:most].tolist()


def test_features_of_several_words():
    assert list(resampling.features([b"a", b"b", b"c"], 2)) == [b"a", b"b", b"c", b"a b", b"b c"]
