"""Odd rows, brute force and simulations for what the other tests leave out."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import context_mixing, fingerprint, langid, mixing, packing, secrets, topk_search, url_filter, warc_revisit

WORDS = [f"w{i}" for i in range(300)]


def _text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# Language ID


def test_language_id_with_nothing_to_learn(spark):
    assert langid.codewords(0).shape == (0, 0) and langid.codewords(1).shape == (1, 0)
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], schema)
    assert langid.identify_split(none, F.lit(True), F.lit(False)).collect() == []
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], schema)
    found = langid.identify_split(docs, F.lit(True), F.lit(False)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in found) == [(1, "und", 0.0), (2, "und", 0.0)]


def test_language_id_on_held_out_texts(spark):
    """Four invented languages, each with syllables of its own and some that all share."""
    rng, rows = np.random.default_rng(4), []
    own = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "lo", "ur"], "cc": ["tza", "ne", "qui"], "dd": ["vel", "dor", "ys"]}
    for i in range(240):
        lang = list(own)[i % 4]
        rows.append((i, " ".join("".join(rng.choice([*own[lang], "an", "te"], 3)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify_split(docs, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0).filter("held_out").collect()
    assert len(found) == 80 and sum(r.lang_pred == rows[r.doc_id][2] for r in found) >= 79


# Fingerprints


def test_likeness_of_a_long_text_of_equal_lines():
    long = "one two three four\n" * 65_536
    a, b = fingerprint.fingerprints([long, long + "more"])
    assert fingerprint.likeness(a, b) > 0.99


# Top-k


def test_top_k_takes_every_row(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 40))
    ids = [int(i) for i in rng.integers(0, 150, 400)]  # most ids several times
    rows = [(i, x.tolist()) for i, x in zip(ids, v, strict=True)]
    found = topk_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_bytes=2_000).collect()
    ints = np.floor(256 * v).astype(int)
    expected = []
    for q in [i for i in range(400) if ids[i] % 50 == 0]:
        scores = ints @ ints[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], ids[i]))[:5]
        expected += [(ids[q], k + 1, ids[i], int(scores[i])) for k, i in enumerate(order)]
    assert sorted(map(tuple, found)) == sorted(expected)


# Revisits


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, status int")


def test_revisit_headers_and_urls(spark):
    rows = [
        (1, "HTTP://A.example:80/q?next=/home/#x", 10, "response", '"v"', None, {"Date": "1", "Content-Type": "text"}, 0),
        (2, "http://a.example/q/?next=/home/", 20, "revisit", 'W/"v"', None, {"date": "2", "ETag": '"v"', "Content-Length": "0"}, 0),
        (3, "http://a.example/q?next=/home", 30, "revisit", '"v"', None, None, 0),
        (4, "http://a.example/q?next=/home/", 40, "revisit", None, None, None, 0),
    ]
    found = {r.record_id: r for r in warc_revisit.resolve_revisits(_records(spark, rows)).collect()}
    assert found[2].source_id == 1 and found[2].status == "resolved"
    assert found[2].headers == {"Content-Type": "text", "date": "2", "ETag": '"v"'}
    assert found[3].status == "orphan" and found[4].status == "unvalidated"


def test_revisits_against_a_sequential_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"http://h{rng.integers(4)}.example/", int(rng.integers(0, 300_000)), ["response", "revisit"][i % 2], f'"{rng.integers(3)}"', None, {"date": str(i)}, 0) for i in range(300)]
    found = {r.record_id: r for r in warc_revisit.resolve_revisits(_records(spark, rows)).collect()}
    for i, url, ts, kind, etag, *_ in rows:
        if kind == "revisit":
            earlier = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
            source = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            status = "orphan" if source is None else "resolved" if source[4] == etag else "mismatch"
            assert (found[i].source_id, found[i].status) == (source and source[0], status)
    assert warc_revisit.resolve_revisits(_records(spark, [])).collect() == []


# Packing


@pytest.mark.parametrize("targets", [None, {"sa": 1, "sb": 2, "sc": 3}])
def test_packing_is_a_deficit_round_robin(targets):
    """The closed form against a scheduler that goes from window to window and carries the
    sources' deficits: credit is the tokens due so far, less those served."""
    totals = {"sa": 1_111, "sb": 2_345, "sc": 7_003}
    plan = packing.Plan(totals, targets, 100)
    start, tokens, base, cumulative = plan.phases[0]
    share = [Fraction(cumulative[i + 1] - cumulative[i], tokens) for i in range(3)]
    credit = [Fraction(0)] * 3
    for window in range(tokens // 100):
        credit = [c + 100 * s for c, s in zip(credit, share, strict=True)]
        whole, taken = Fraction(0), []
        for c in credit:  # in source order; what one's rounding leaves goes to the next
            taken.append((whole + c).__floor__() - whole.__floor__())
            whole += c
        credit = [c - t for c, t in zip(credit, taken, strict=True)]
        x0, x1 = plan.bounds(window)
        assert [plan.served(i, x1) - plan.served(i, x0) for i in range(3)] == taken and sum(taken) == 100
        assert all(abs(c) < 1 for c in credit)  # every window is at the target proportions, but for a token
    for i, n in enumerate(totals.values()):
        assert plan.served(i, plan.total) == n


# Mixing


def test_inclusion_frequencies(spark):
    """Pareto samples by many seeds: how often a document is in against its probability."""
    sizes = [3, 5, 8, 13, 21, 34] * 40 + [900]
    rest = 1_800
    due = spark.createDataFrame([("s", s, rest) for s in sizes], "key string, size long, rest long")
    row = mixing.inclusion_rates(due).head()
    s = np.array(sizes, dtype=float)
    p = np.where(s >= row.certain, 1.0, row.rate * s)
    assert p[-1] == 1 and abs((p * s).sum() - rest) < 1e-6 and p[:-1].max() < 1
    rng, hits = np.random.default_rng(7), np.zeros(len(s))
    q = np.clip(p, 1e-12, 1 - 1e-12)
    for _ in range(2_000):
        u = rng.random(len(s))
        odds = np.where(s >= row.certain, 0, u / (1 - u) / (q / (1 - q)))
        order = np.argsort(odds)
        taken = np.cumsum(s[order]) - s[order] < rest
        hits[order[taken]] += np.clip((rest - (np.cumsum(s[order]) - s[order])[taken]) / s[order][taken], 0, 1)
    for size in set(sizes):
        assert abs(hits[s == size].mean() / 2_000 - p[s == size][0]) < 0.02


# Context mixing


def _words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def _counted(texts):
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        w = ["^", *_words(t)]
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    return one, two, three


def test_counts_of_words_pairs_and_triples(spark):
    texts = [_text(i % 7, 40 + i) for i in range(30)] + [None, "", "  ", "Same same SAME same", "é ß é"]
    rows = [(i, t, i % 4 != 0, i % 4 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, held_out boolean").repartition(3)
    units, tokens, distinct, learnable = context_mixing.counted_units(docs)
    one, two, three = _counted([r[1] for r in rows if r[2]])
    assert (tokens, distinct, learnable) == (sum(one.values()), len(one), sum(r[2] for r in rows))
    seen = 0
    for unit in units.collect():
        c1, c2, c3 = (context_mixing._whole(bytes(unit[c])) for c in ("c1", "c2", "c3"))
        at = 0
        for i in unit.doc_ids:
            w = ["^", *_words(texts[i])]
            n = len(w) - 1
            assert c1[at : at + n].tolist() == [one[x] for x in w[1:]]
            assert c2[at : at + n].tolist() == [two[x] for x in zip(w, w[1:], strict=False)]
            assert c3[at + 1 : at + n].tolist() == [three[x] for x in zip(w, w[1:], w[2:], strict=False)]
            at, seen = at + n, seen + 1
    assert seen == len(texts)


def test_probabilities_of_all_continuations_add_up():
    texts = [_text(i % 5, 30) for i in range(20)]
    one, two, three = _counted(texts)
    rng = np.random.default_rng(9)
    tables, weights = rng.normal(size=(3, 3, 256)).astype(np.float32), context_mixing.start_weights()
    begin = _words(texts[0])[:12]
    total, left = 0.0, None
    for w in one:
        line = ["^", *begin, w]
        counts = [np.array([one[x] for x in line[1:]]), np.array([two[x] for x in zip(line, line[1:], strict=False)]), np.array([0, *(three[x] for x in zip(line, line[1:], line[2:], strict=False))])]
        sources = context_mixing.Sources(*counts, np.array([len(line) - 1]), sum(one.values()), len(texts), False)
        chances = context_mixing.source_chances(sources, tables, weights)
        total += 10 ** context_mixing.token_logs(sources, chances, np.zeros(len(line) - 1))[-1]
        left = np.prod(1 - chances[:, -1])
    assert abs(total + left - 1) < 1e-6


def test_moving_weights_against_a_scalar_mixer():
    rng = np.random.default_rng(10)
    sizes = np.array([70, 33, 1])
    n = int(sizes.sum())
    c1 = rng.integers(0, 50, n)
    c2 = np.minimum(c1, rng.integers(0, 5, n))
    c3 = np.minimum(c2, rng.integers(0, 3, n))
    sources = context_mixing.Sources(c1, c2, c3, sizes, 5_000, 40, False)
    tables, weights = rng.normal(size=(3, 3, 256)).astype(np.float32), rng.normal(size=(3, 8, 5)) / 3
    found = context_mixing.source_chances(sources, tables, weights)
    for bit in range(3):
        x = sources.inputs(tables, bit).astype(float)
        for first, size in zip(sources.first, sizes, strict=True):
            own, step = np.zeros(5), np.zeros(5)
            for k in range(size):
                t = first + k
                if k % context_mixing.BLOCK == 0:
                    own, step = np.clip(own + context_mixing.RATE * step, -context_mixing.BOUND, context_mixing.BOUND), np.zeros(5)
                p = 1 / (1 + np.exp(-np.clip(x[t] @ (weights[bit][sources.gate[t]] + own), -12, 12)))
                assert abs(found[bit][t] - (p if sources.there[bit][t] else 0)) < 1e-4
                if sources.coded[bit][t]:
                    step += (sources.value[bit][t] - p) * x[t]


def test_score_of_held_out_texts_is_above_the_base(spark):
    texts = [_text(i % 9, 80) + " " + _text(100 + i, 20) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = context_mixing.score_split(docs, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0).filter("held_out").collect()
    assert len(found) == 12 and sum(r.score for r in found) > sum(r.base_score for r in found)
    assert context_mixing.score_split(docs.filter("false"), F.lit(True), F.lit(False)).collect() == []


# URL filter, secrets


def test_url_model_on_unseen_words(spark):
    bad = ["megacasino", "pokerbets", "pillshop", "spammers", "adultcams", "freecasino"]
    good = ["newsroom", "museums", "librarian", "weathermap", "schoolgarden", "musichistory"]
    rows = [(i, f"http://{w}.example.org/about/{i}") for i, w in enumerate(bad + good)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert sum(found[i] == ("block" if i < len(bad) else "allow") for i in found) >= 11


def test_base_rules_against_plain_patterns():
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))  # ASCII letters
    assign = re.compile(rf"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    access, hexed = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
    rng = np.random.default_rng(11)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "xyz_9.=", "é", "\n", "short", "longervalue1", "ſecret"]
    for _ in range(400):
        text = "".join(rng.choice(parts, 25))
        expected = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        expected += [(m.start(), m.end(), "access") for m in access.finditer(text) if len(m[0]) >= 16]
        expected += [(m.start(), m.end(), "hex") for m in hexed.finditer(text) if len(m[0]) >= 32]
        assert sorted(secrets.scan(text)[0]) == sorted(expected), text


# Pipeline


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, ambiguous int, size int, taken int, cut int, row_key int, _mix int, component int"


def _clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, "x", 1, 2, 3, 4, 5, 6, 7) for i, t, lang, s in rows], CLASHING)


def test_stages_with_clashing_columns_and_empty_tables(spark):
    import corpus_pipeline

    rows = [(i, f"the cat number{i} and the dog {_text(i, 30)}", "en", "a") for i in range(8)] + [(20, None, "en", None), (None, "", None, "b"), (5, "123", "en", "b")]
    for docs in (_clashing(spark, rows), _clashing(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            assert all((r.score, r["size"], r.taken, r.cut, r.row_key, r["_mix"]) == (0.5, 2, 3, 4, 5, 6) for r in out.collect())


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    base = " ".join(["the cat and the dog went out to see what the weather was like in the garden"] * 3)
    rows = [(i, f"{base} {_text(i, 25)}", "en", ["a", "b"][i % 2], 0) for i in range(10)]
    rows += [(30, rows[0][1], "en", "a", 0), (31, None, "en", "a", 0), (32, "12 34", "en", "b", 0), (33, f"{base} {_text(33, 25)} password = hunter2hunter2", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in pieces}
    assert not ids & {30, 31, 32} and ids <= set(range(10)) | {33}
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 4096
