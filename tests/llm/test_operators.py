"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import json
import base64
import zlib
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import context_mixing, fingerprint, langid, mixing, ngram_jaccard, packing, secrets, topk_search, url_filter, warc_revisit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"  # size: a clashing name
WORDS = [f"w{i}" for i in range(400)]


def _text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def _docs(spark, rows=None):
    base = _text(1)
    near = base.replace("w3", "x", 1)
    rows = rows if rows is not None else [(5, base), (3, base + " tail"), (9, near), (4, _text(2)), (7, None), (8, ""), (2, " \t\n"), (11, "one two"), (12, "One  two"), (None, _text(3)), (13, _text(4, 3000)), (13, _text(4, 3000))]
    return spark.createDataFrame([(i, t, "en", ["a", None, "b"][k % 3], len(t or ""), k) for k, (i, t) in enumerate(rows)], DOCS)


def _sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("num", "words"), [(85, 4), (80, 5)])
def test_jaccard_components(spark, num, words):
    rng, rows = np.random.default_rng(3), []
    for g in range(6):
        base = list(rng.choice(WORDS, [6, 12, 40, 90, 200, 9][g]))
        for c in range(6):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 20 + c % 2))):
                text[int(rng.integers(len(text)))] = "edit" + str(int(rng.integers(50)))
            rows.append((100 - len(rows), " ".join(text)))
    docs = _docs(spark, [*rows, (500, None), (501, "")])
    sets = {i: _sets(t, words) for i, t in [*rows, (500, None), (501, "")]}
    best = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    found = ngram_jaccard.jaccard_components(docs, words, num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), best[i]) for i in sets}
    assert links


def test_prefix_keys_lose_no_pair():
    rule, rng = ngram_jaccard.Threshold(85, 100), np.random.default_rng(5)
    for n in [*range(1, 60), 150, 700]:
        values = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = values.copy()
        k = 0
        while k + 1 < n and rule.linked(n - k - 1, n, n):
            k += 1
            other[k - 1] = rng.integers(2**63)
        other = np.unique(other)
        levels = rng.integers(0, 4, 1 << ngram_jaccard.SKETCH_BITS).astype(np.uint8)
        assert np.intersect1d(ngram_jaccard.prefix_keys(values, levels, rule), ngram_jaccard.prefix_keys(other, levels, rule)).size


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_jaccard.jaccard_components(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert fingerprint.compare_with_edits(none).count() == 0
    assert secrets.scan_documents(none).count() == 0


def test_fingerprints(spark):
    docs = _docs(spark)
    rows = sorted([(r.doc_id, r.text or "") for r in docs.collect()], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    found = fingerprint.compare_with_edits(docs, 3).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    a, b = fingerprint.fingerprints(["x y z\nq", "q\nx y z"])
    assert a == b
    whole, part, rest = fingerprint.fingerprints(["x y z\nq", "x y z", "q"])
    assert fingerprint.combine(part, rest) == whole and fingerprint.combine(whole, rest, -1) == part


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    docs = _docs(spark)
    coder = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=64).collect()
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == 64 or end & (end - 1) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = [r for r in pieces if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == len(ids) * (2 if doc_id == 13 else 1)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in mine)


def test_word_cache_agrees_with_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    coder = packing.WordTokenizer(path, False)
    for text in ["It's 12 o'clock, isn't it?", "Éçole ÀÈ straße 3.14 a_b", "İstanbul ΣΑΣ <|endoftext|> x", "漢字 テスト end", "é a<b>", "''' 're 'S"]:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_word_cache_keeps_separators():
    public = pytest.importorskip("public_tokenizers")
    coder = packing.WordTokenizer(public.path("word_bpe_49k.json"), False)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = np.random.default_rng(8)
    texts = ["ab\x1ccd", "ab \x1d cd", "\x1e", "a\x1f\x1f\nB \x1c", *[f"ab{c}cd {c} Ef{c}" for c in blanks]]
    texts += ["".join(rng.choice([*blanks, "ab", "Cd", "7", "'s", "é", "\x1d", "\x1c"], 12)) for _ in range(200)]
    for text in texts:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_targets_drain_queues():
    plan = packing.Plan({"sa": 100, "sb": 1000}, {"sa": 1, "sb": 1}, 50)
    shares = [(plan.served(0, b) - plan.served(0, a), plan.served(1, b) - plan.served(1, a)) for a, b in map(plan.bounds, range(plan.full))]
    assert shares[:4] == [(25, 25)] * 4 and shares[4:] == [(0, 50)] * (plan.full - 4)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 40)).astype("float32")
    v[7] = v[8]
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(900, None, 0), (901, [float("nan")] * 40, 0), (902, [None] * 40, 0), (903, [], 0)]
    found = topk_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()
    ints = np.floor(256 * v.astype(float)).astype(int)
    expected = []
    for q in range(0, 300, 50):
        scores = ints @ ints[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:5]
        expected += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(order)]
    assert sorted(map(tuple, found)) == expected


def test_mixing_meets_targets(spark):
    rows = [(i, _text(i, 5 + i % 40)) for i in range(300)] + [(400, None), (None, "a b")]
    found = mixing.mix_sources(_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    taken, target, total = {}, {}, 0
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        total += r.size
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and abs(sum(target.values()) - total) < 1e-6


STAGED = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("repeat", [False, True])
def test_near_copy_stage_with_null_and_repeated_ids(spark, repeat):
    import corpus_pipeline

    a, b, c, d, e = (_text(s, 80) for s in range(50, 55))
    rows = [(None, a), (None, a + " tail"), (None, a), (None, b), (None, c + " x"), (6, c), (4, c + " y"), (None, None), (None, ""), (9, None), (10, " ")]
    kept = [(None, a), (None, b), (4, c + " y"), (None, None), (None, ""), (9, None), (10, " ")]
    if repeat:
        rows += [(7, d), (7, e), (7, d + " tail"), (8, e), (9, None), (3, "one"), (3, "two")]
        kept += [(7, d), (7, e), (9, None), (3, "one"), (3, "two")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], STAGED).coalesce(1)
    found = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in found.collect()], key=repr) == sorted(kept, key=repr)


def test_mixing_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None if i % 3 == 0 else i % 5, f"t{i} " + _text(i, 3 + i % 20), "en", ["a", "b", None][i % 3 if i % 7 else 1], 0) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, None, "en", "a", 0), (None, " ", "en", "a", 0)], STAGED)
    found = corpus_pipeline.mix_to_weights(spark, docs, "")
    assert found.columns == docs.columns
    out, sizes = found.collect(), {r[1].split()[0]: r for r in rows}
    for r in out:
        whole = sizes[r.text.split()[0]]
        assert (r.doc_id, r.source) == (whole[0], whole[3]) and whole[1].startswith(r.text) and r.n_chars == len(r.text)
    targets = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
    words = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in targets}
    assert all(abs(words[s] - targets[s]) <= 1 for s in targets), (words, targets)


def test_language_id(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "123 !?", "en"), (92, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:40])
    assert found[90].lang_pred == found[91].lang_pred == "und" and found[92].lang_pred == "en"


@pytest.mark.parametrize("n", [2, 7, 8, 9, 12])
def test_codewords_end_and_differ(n):
    code = langid.codewords(n)
    splits = {min(tuple(c), tuple(1 - c)) for c in code.T}
    assert len(splits) == code.shape[1] == {2: 1, 7: 63, 8: 35}.get(n, langid.BITS)
    assert len({tuple(r) for r in code}) == n


def test_context_mixing_base_and_normalization(spark):
    from pyspark.sql import functions as F

    docs = _docs(spark)
    found = context_mixing.score_split(docs, F.col("doc_id") != 4, F.lit(False)).collect()
    counts = {}
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id != 4:
            for w in [*(r.text or "").encode().lower().split(), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in found:
        texts = [d.text for d in docs.collect() if d.doc_id == r.doc_id]
        words = [*(texts[0] or "").encode().lower().split(), b"\n"]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_secrets(spark):
    header, payload = (base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode() for x in ({"alg": "HS256"}, {"sub": "1"}))
    text = f'é password = "hunter22x" AKIA{"A" * 16} {"ab" * 20} {header}.{payload}.sig token: short'
    base, more = secrets.scan(text)
    assert [k for _, _, k in sorted(base)] == ["assign", "access", "hex"] and [k for _, _, k in more] == ["jwt"]
    assert text[more[0][0] : more[0][1]] == f"{header}.{payload}.sig"
    assert secrets.scan(f"x {base64.urlsafe_b64encode(b'not json at all, no token').decode()}.a.b")[1] == []
    der = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))
    assert secrets.key_encoding(der) == "pkcs8" and secrets.key_encoding(der[:-1]) is None
    assert "key_base64" in [k for _, _, k in secrets.scan("k " + base64.b64encode(der).decode())[1]]
    assert secrets.redact("a password=abcdefgh b") == "a [assign] b"


def _der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (b"\x82" + len(body).to_bytes(2, "big"))
    return bytes([tag]) + size + body


def _number(n, seed):
    return _der(0x02, b"\x01" + np.random.default_rng(seed).bytes(n - 1))


_RSA = _der(0x30, _der(0x02, b"\0"), _number(256, 1), _der(0x02, b"\1\0\1"), *[_number(128, s) for s in range(2, 8)])
_DSA = _der(0x30, _der(0x02, b"\0"), _number(128, 1), _number(20, 2), _number(128, 3), _number(128, 4), _number(20, 5))
_LOCKED = _der(0x30, _der(0x30, _der(0x06, bytes.fromhex("2a864886f70d01050d")), _der(0x30)), _der(0x04, bytes(range(64))))


def _wrapped(data, width, joint="\n"):
    text = base64.b64encode(data).decode()
    return joint.join(text[i : i + width] for i in range(0, len(text), width))


def test_key_encodings_dsa_and_encrypted():
    assert secrets.key_encoding(_RSA) == "pkcs1"
    assert secrets.key_encoding(_DSA) == "dsa" and secrets.key_encoding(_DSA[:-1]) is None
    assert secrets.key_encoding(_LOCKED) == "pkcs8-encrypted"
    assert secrets.key_encoding(_der(0x30, *[_number(4, s) for s in range(6)])) is None
    assert secrets.key_encoding(_der(0x30, _der(0x30, _der(0x06, b"\x55\x04\x03")), _der(0x04, b"x" * 40))) is None


@pytest.mark.parametrize("joint", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n"])
def test_pem_with_escaped_breaks_and_headers(joint):
    for label, headers, data in [
        ("RSA PRIVATE KEY", [], _RSA), ("DSA PRIVATE KEY", [], _DSA), ("ENCRYPTED PRIVATE KEY", [], _LOCKED), ("RSA PRIVATE KEY", ["Comment: mine, or not", ""], _RSA),
        ("RSA PRIVATE KEY", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0A" * 16, ""], bytes(range(64))),
    ]:
        block = joint.join([f"-----BEGIN {label}-----", *headers, _wrapped(data, 64, joint), f"-----END {label}-----"])
        text = f'{{"kind": "x", "key": "{block}{joint}"}}'
        assert [(text[a:b], k) for a, b, k in secrets.scan(text)[1]] == [(block, "pem")], (label, headers)
    plain = joint.join(["-----BEGIN RSA PRIVATE KEY-----", "not a key", "-----END RSA PRIVATE KEY-----"])
    assert secrets.scan(plain)[1] == []


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("joint", ["\n", "\r\n", "\n    ", "\\n"])
def test_wrapped_base64_keys(width, joint):
    string = lambda x: len(x).to_bytes(4, "big") + x
    openssh = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(bytes(51)) + string(bytes(136))
    ssh = string(b"ssh-rsa") + string(b"\1\0\1") + string(bytes(257))
    for data in (_RSA, _DSA, _LOCKED, openssh, ssh):
        key = _wrapped(data, width, joint)
        for text in (f"the{joint}{key}{joint}after{joint}it", key, f"{key}{joint}{key}", f"{base64.b64encode(b'A' * 48).decode()}{joint}{key} x"):
            found = secrets.scan(text)[1]
            assert [(text[a:b], k) for a, b, k in found] == [(key, "key_base64")] * text.count(key), (len(data), text[:40])
    assert secrets.scan(_wrapped(_RSA, width, joint)[:-30])[1] == []
    assert secrets.redact(f"a {_wrapped(_RSA, width, joint)} b") == "a [key_base64] b"


def test_url_rules_and_model(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = ["HTTP://A.Example.COM/en/7x", "http://a.com/en/1", "http://xcom/en/1", None, "no scheme", "http://b.net?x", "http://casino-win.example.org/fr/1", "http://library.example.org/fr/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, model).collect()}
    assert (found[0].rule, found[0].verdict, found[0].host) == ("example.com/en/7", "allow", "a.example.com")
    assert found[1].rule == "com/en/" and found[2].rule is None
    assert (found[3].host, found[4].path, found[5].host, found[5].path) == ("", "", "b.net", "")
    assert (found[6].verdict, found[7].verdict) == ("block", "allow")


def test_revisits(spark):
    rows = [
        (1, "http://a.org/x", 10, "response", '"e1"', None, {"date": "10", "content-type": "t"}),
        (2, "HTTP://A.org:80/x/#f", 200_000, "revisit", 'W/"e1"', None, {"date": "20", "content-type": "z"}),
        (3, "http://a.org/x", 200_001, "revisit", '"other"', None, {}),
        (4, "http://a.org/x", 5, "revisit", '"e1"', None, {}),
        (5, None, 5, "revisit", None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    found = {r.record_id: r for r in warc_revisit.resolve_revisits(records).collect()}
    assert [found[i].status for i in (2, 3, 4, 5)] == ["resolved", "mismatch", "orphan", "orphan"]
    assert found[2].headers == {"date": "20", "content-type": "t"}
