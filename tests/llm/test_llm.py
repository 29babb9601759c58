"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornlake.llm import decontam, fingerprint, langid, neardup, packing, pii, substring, tokencount, toxicity, urlgraph

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use.
EXTRA = ("spans", "clean_text", "fingerprint", "score", "lang_pred", "matches", "node", "key", "mini", "wanted", "bucket", "hash", "label", "piece", "kept", "ranges")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sentence(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, empty, null, one-word, odd-space and long texts, repeated rows."""
    rng = random.Random(7)
    base = [sentence(rng, 120) for _ in range(12)]
    passage = sentence(rng, 70)
    texts = [*base, base[0], base[0], base[3].upper(), None, "", "one", " \t\n", "a b c d", "a b c d", "x\u00a0y z\x1cq\u2003r"]
    for k in range(8):
        words = base[1].split()
        words[k * 11] = "changed"
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}" for _ in range(6)]
    texts += [passage + " " + passage, sentence(rng, 20_000), "Z" * 50_000]
    out = [(i * 3 + 1, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[2], out[-3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clash(spark.createDataFrame(rows, SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1 personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    alphabet = "a.b@c-d+1 2(3)4567890%_é\n"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    samples = ["x@y.com@z.org", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (386) 555-3733", "256.1.1.1 0001.2.3.4", "a@b", "@b.c", "..@a.b.c-", "+1(((("]
    for text in samples:
        assert pii.base_spans(text) == plain_spans(text)
    pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)  # linear


def test_pii_digests_and_rewriting(spark, docs, nothing):
    texts = ["mail a.b@x.com now", None, "", "call +1 (386) 555-3733 or 4111111111111111 at 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.digest(pii.sanitize(df)).collect():
        joined = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == sha(joined) and r.spans == joined
    clean = {r.doc_id: r.clean_text for r in pii.sanitize(df).collect()}
    assert clean[0] == "mail [EMAIL] now" and clean[1] is None and clean[3] == "call [PHONE] or [CARD] at [IP]"
    assert pii.sanitize(docs).count() == docs.count() and pii.sanitize(nothing).count() == 0


@pytest.mark.parametrize("told", [pii.TOLD, 0])
def test_disclosing_terms(spark, told):
    rng = random.Random(3)
    filler = [f"word{k}" for k in range(60)]
    texts = [f"{' '.join(rng.sample(filler, 8))} Zanzibarman wrote from spy@secret.org {' '.join(rng.sample(filler, 6))}" for _ in range(6)]
    texts += [" ".join(rng.sample(filler, 20)) for _ in range(80)] + ["the zanzibarman alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.sanitize(df, told=told).collect()}
    assert "zanzibarman" not in found[0].clean_text.lower() and "[EMAIL]" in found[0].clean_text
    assert [s.kind for s in found[86].spans] == ["term"] and found[40].spans == []
    copies = spark.createDataFrame([(i, texts[0]) for i in range(9)], "doc_id long, text string")
    assert pii.disclosing_terms(copies).isEmpty()  # one surrounding only


def test_disclosing_terms_below_a_letterhead(spark):
    """The address first stands in the same letterhead everywhere; its later surroundings differ."""
    rng = random.Random(4)
    filler = [f"word{k}" for k in range(60)]
    some = lambda n: " ".join(rng.sample(filler, n))
    texts = [f"office spy@secret.org {'house ' * 12} {some(20)} Zanzibarman spy@secret.org {some(12)}" for _ in range(6)]
    df = spark.createDataFrame(list(enumerate([*texts, *(some(20) for _ in range(80))])), "doc_id long, text string")
    assert "zanzibarman" in {r.term for r in pii.disclosing_terms(df).collect()}


def test_disclosing_terms_equal_brute_force(spark):
    """PMI and information content of every pair, by counting documents."""
    rng = random.Random(8)
    filler = [f"word{k}" for k in range(80)] + ["İstanbul", "x" * 90]
    people = [("Quillmore", "anna@one.org"), ("Farrowby", "+1 (386) 555-3733"), ("Tarn7", "10.0.0.1"), ("Quillmore", "bert@one.org")]
    texts = [None, ""]
    for k in range(120):
        words = rng.choices(filler, k=rng.randrange(4, 50))
        for name, value in rng.sample(people, k % 3):
            at = rng.randrange(len(words))
            words[at:at] = [name, " " * rng.randrange(1, 700), value]
        texts.append(" ".join(words))
    texts += texts[40:50]
    term = re.compile(r"[^\W_]{3,}")
    holds = [{t.lower() for t in term.findall(text or "")} for text in texts]
    of_entity, together, contexts = {}, {}, {}
    for d, text in enumerate(texts):
        spans = plain_spans(text)
        chars = list(text or "")
        for s, _, e in spans:
            chars[s:e] = " " * (e - s)
        for s, kind, e in spans:
            near = [t.lower() for t in term.findall("".join(chars[:s]))][-12:] + [t.lower() for t in term.findall("".join(chars[e:]))][:12]
            for name in pii.entities(text, kind, s, e):
                of_entity.setdefault(name, set()).add(d)
                for t in set(near):
                    together.setdefault((name, t), set()).add(d)
                    contexts.setdefault((name, t), set()).add(frozenset(near))
    expected = {}
    for (name, t), docs in together.items():
        ic = math.log2(len(texts) / len(of_entity[name]))
        pmi = math.log2(len(texts) * len(docs) / (len(of_entity[name]) * sum(t in h for h in holds)))
        if len(contexts[name, t]) >= 2 and ic > 0 and pmi / ic >= 0.8:
            expected[t] = max(expected.get(t, 0.0), pmi / ic)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.term: r.ratio for r in pii.disclosing_terms(df).collect()}
    assert found.keys() == expected.keys() and {"quillmore", "farrowby"} <= found.keys()
    assert all(abs(found[t] - expected[t]) < 1e-9 for t in found)
    by_join = {r.doc_id: (r.spans, r.clean_text) for r in pii.sanitize(df.withColumns({c: F.lit(1) for c in ("text_sha", "own_terms", "id", "term")}), told=0).collect()}
    assert by_join == {r.doc_id: (r.spans, r.clean_text) for r in pii.sanitize(df).collect()}


# 2 fingerprints


def canonical(text):
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip(" ")


def test_fingerprints(spark, docs, rows, nothing):
    found = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (-x[0], x[1]))
    for k, (i, t) in enumerate(order):
        if [x for x, _ in order].count(i) > 1:
            continue
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert r.near_edited == float(canonical(t) == canonical(edited)) and r.near_next == float(canonical(t) == canonical(after))
    by = {}
    for i, t, *_ in rows:
        by.setdefault(canonical(t or ""), set()).add(found[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    assert fingerprint.edited_fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(one).first().edited_sha256 == sha("abab")


def test_fingerprint_collisions(spark, monkeypatch):
    wide = fingerprint.wide_hash
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c, lanes=2: F.substring(wide(c, lanes), 1, 1))
    rng = random.Random(2)
    texts = [f"t{rng.randrange(900)}" for _ in range(1500)] + ["ﬁ", "FI", "Straße", "STRASSE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(canonical(t), set()).add(found[i])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups) > 256


# 3 toxicity


def test_toxicity(spark, docs, nothing):
    rng = random.Random(5)
    made = []
    for i in range(1200):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(10, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "zorkfoo", "zorkbar", "zorkbaz", "m0ron"]))
        made.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic").filter("doc_id % 4 <> 2"))
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(found[i].predicted, y) for i, _, y in made if i % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    again = toxicity.fit(df, df.select("doc_id", "toxic").filter("doc_id % 4 <> 2"))
    assert np.allclose(again.score([t for _, t, _ in made[:50]]), model.score([t for _, t, _ in made[:50]]))
    assert toxicity.score(docs, model).count() == docs.count()
    blank = toxicity.fit(df, df.select("doc_id", "toxic").filter("toxic = 0"))
    assert blank.score(["x", None, ""]).tolist() == [0.0] * 3
    assert toxicity.score(nothing, toxicity.fit(nothing, df.select("doc_id", "toxic").limit(0))).count() == 0
    assert toxicity.plain("1d!0t") == "idiot" and toxicity.isotonic(np.arange(4.0), np.array([0, 1, 0, 1.0]))[1].tolist() == sorted(toxicity.isotonic(np.arange(4.0), np.array([0, 1, 0, 1.0]))[1].tolist())


def test_first_split_equals_a_plain_search():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 2] > 5) ^ (rng.random(300) < 0.1)).astype(float)
    model = toxicity.Trees(x, y)
    p = 1 / (1 + np.exp(-model.start))
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = (0.0, None, None)
    for f in range(4):
        for edge in model.edges[f]:
            left = x[:, f] <= edge
            if min(left.sum(), (~left).sum()) >= toxicity.LEAST_LEAF:
                gain = sum(g[side].sum() ** 2 / (h[side].sum() + 1) for side in (left, ~left))
                if gain > best[0] + 1e-9:
                    best = (gain, f, edge)
    feature, cut, value = model.trees[0]
    assert (feature[0], model.edges[feature[0]][cut[0]]) == best[1:]
    # margins by walking each tree
    def walk(row):
        total = model.start
        for feature, cut, value in model.trees:
            k = 0
            for _ in range(toxicity.DEPTH):
                f = feature[k]
                k = 2 * k + 1 + int(f >= 0 and row[f] > model.edges[f][cut[k]])
            total += value[k]
        return total

    assert np.allclose(model.margin(x[:40]), [walk(r) for r in x[:40]])
    assert np.mean((model.margin(x) > 0) == (x[:, 2] > 5)) > 0.9  # a tenth of the labels is noise


def test_isotonic_pools_equal_the_min_max_solution():
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(40))
    y = (rng.random(40) < x).astype(float)
    fit = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    ends = [i for i in range(40) if i in (0, 39) or abs(fit[i] - fit[i - 1]) > 1e-12 or abs(fit[i] - fit[i + 1]) > 1e-12]
    knots, values = toxicity.isotonic(x, y)
    assert sorted(set(knots.tolist())) == x[ends].tolist() and values.tolist() == sorted(values.tolist())


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (1, 0)], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, "you idiot"), (2, "fine"), (None, "x"), (3, None), (9, "!" * 200_000), (2, "fine")], "doc_id long, text string")
    found = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found) and found[1].score == found[5].score
    # features of a long text are those of the whole of it
    lexicon = toxicity.Lexicon({"zork": 2.0})
    values = dict(zip(toxicity.NAMES, lexicon.features("calm words. " * 20_000 + "ZORK you, M0RON!"), strict=True))
    assert values["word_hits"] == math.log1p(1) and values["insults"] == math.log1p(1) and values["proximity"] == math.log1p(2)
    text = "Aé ß Ω! 12 _x 𝒜…"
    assert toxicity.char_counts(text).tolist() == [sum(map(str.isalpha, text)), sum(map(str.isupper, text)), len(re.findall(r"[^\w\s]", text))]


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "mail a@b.co now"), (None, None), (5, "mail a@b.co now"), (5, "mail a@b.co now")], "doc_id long, text string")
    kinds = Counter((r.doc_id, r.n_email) for r in pii.digest(pii.sanitize(df)).collect())
    assert kinds == {(None, 1): 1, (None, 0): 1, (5, 1): 2}
    prints = fingerprint.edited_fingerprints(df).collect()
    assert Counter(r.doc_id for r in prints) == {None: 2, 5: 2} and len({r.fingerprint for r in prints if r.n_chars}) == 1
    assert Counter((r.doc_id, r.n_pretokens) for r in tokencount.count_tokens(df).collect()) == {(None, 3): 1, (None, 0): 1, (5, 3): 2}
    model = {"aa": b"mail now a b co mail now", "bb": b"something else entirely here"}
    assert Counter((r.doc_id, r.lang_pred) for r in langid.classify(df, model).collect()) == {(None, "aa"): 1, (None, "und"): 1, (5, "aa"): 2}
    bench = spark.createDataFrame([(1, "mail a b co now"), (1, "mail a b co now")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()) == {(None, 1): 2, (5, 1): 4}
    assert Counter(r.doc_id for r in packing.pack(df).collect()) == {None: 2, 5: 2}


# 4 substrings


@pytest.mark.parametrize("hot", [20_000, 1, 3])
def test_substring_removal(spark, docs, rows, nothing, hot):
    words = {(i, t): WORD.findall(t or "") for i, t, *_ in rows}
    first = {}
    for (i, _), w in words.items():
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    expected = Counter()
    for i, t, *_ in rows:
        w = words[i, t]
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        expected[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert Counter(got(substring.keep_unique(docs, hot_strings=hot), "doc_id", "n_words", "n_removed", "kept_text")) == expected
    assert sum(n for _, _, n, _ in expected) > 300
    assert substring.keep_unique(nothing).count() == 0
    null_id = spark.createDataFrame([(None, rows[0][1]), (9, rows[0][1])], "doc_id long, text string")
    assert {r.n_removed for r in substring.keep_unique(null_id).collect()} == {0}


def test_windows_with_one_hash_are_kept_apart(monkeypatch):
    """All windows get one hash; the texts decide."""
    rng = random.Random(5)
    shared = sentence(rng, 60)
    strings = [f"{sentence(rng, k % 3)} {shared} {sentence(rng, k % 5)}".strip() if k % 2 else sentence(rng, 55) for k in range(30)]
    docs = [rng.randrange(100) for _ in strings]
    expected = []
    windows = [[tuple(s.split()[k : k + 50]) for k in range(len(s.split()) - 49)] for s in strings]
    for d, own in zip(docs, windows, strict=True):
        expected.append([k for k, w in enumerate(own) if min(e for e, o in zip(docs, windows, strict=True) if w in o) < d])
    packed = [s.encode() for s in strings]
    assert [sorted(f) for f in substring._repeats(packed, docs, 50)] == expected
    monkeypatch.setattr(substring, "run_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), dtype=np.uint64))
    assert [sorted(f) for f in substring._repeats(packed, docs, 50)] == expected
    with pytest.raises(ArithmeticError):
        list(substring._count_bucket([(1, 5, packed[0]), (1, 6, packed[1])], 50))


def test_minimisers():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 300).astype(np.uint64)
    from hornlake.llm.common import mix64, run_hashes

    low = mix64(run_hashes(words, 8))
    assert substring.minimisers(words).tolist() == [low[k : k + 43].min() for k in range(251)]
    mini, sid, first, count = substring.super_kmers(words)
    assert count.sum() == 251 and first[0] == 0 and len(set(sid.tolist())) == len(sid)
    _, again, _, _ = substring.super_kmers(np.concatenate((words[:100], words)))
    assert set(sid[1:].tolist()) <= set(again.tolist())


# 5 token counts


def test_token_counts(docs, rows, nothing):
    model = tokencount.Unigram.get("piece_bpe_32k")

    def alone(word):
        text, path = tokencount.MARK + word, [(0.0, 0)]
        while len(path) <= len(text):
            path.append(model.state(text, path))
        return -path[-1][1]

    found = {r.doc_id: r for r in tokencount.count_tokens(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        assert (found[i].n_pretokens, found[i].n_tokens) == (len(w), sum(map(alone, w)))
    small = tokencount.Trie(model, nodes=50)  # begun anew again and again
    words = WORD.findall(" ".join(t or "" for _, t, *_ in rows[:20]))
    assert small.count(words) == tokencount.Trie(model).count(words) == sum(map(alone, words))
    tiny = tokencount.Unigram({"▁": -1.0, "▁ab": -2.0, "ab": -1.5, "c": -1.0, "abc": -4.0, "▁abc": -3.5}, -9.0)
    assert [tokencount.Trie(tiny).insert(w) for w in ("abc", "ab", "abé")] == [2, 1, 3]
    # exhaustive segmentations of short words, with few pieces and with the whole vocabulary
    for unigram, words in ((tiny, ("abcab", "cabc", "abab")), (model, ("the", "Enung", "thshatnt", "señora", "a1b2", "%%%"))):
        for word in words:
            text = "▁" + word

            def ways(at):
                if at == len(text):
                    yield 0.0, 0
                for end in range(at + 1, len(text) + 1):
                    if (s := unigram.pieces.get(text[at:end])) is not None:
                        yield from ((s + a, n + 1) for a, n in ways(end))

            best = max((round(s, 9), -n) for s, n in ways(0))
            assert tokencount.Trie(unigram).insert(word) == -best[1]
    assert tokencount.count_tokens(nothing).count() == 0


# 6 packing


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs).collect()
    ids = {}
    for i, t, *_ in rows:
        ids[i] = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert Counter(p.doc_id for p in pieces) == Counter(i for i, *_ in rows for _ in range(-(-len(ids[i]) // 1024)))
    bins = {}
    for p in pieces:
        own = ids[p.doc_id]
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], dtype="<u4").tobytes())
        assert p.length == 1024 or p.piece == 0
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing).count() == 0
    assert packing.Encoder.get("byte_bpe_50k")("a<|endoftext|>b").tolist() == tok.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_packing_search():
    rng = np.random.default_rng(4)
    for low, high, slack in ((1, 1025, 1.02), (200, 600, 1.06), (340, 520, 1.2)):
        lengths = rng.integers(low, high, 1500)
        start = packing.best_fit(lengths)
        fills = lambda bins: sorted(int(sum(lengths[i] for i in b)) for b in bins)
        before = fills(start)
        bins = packing.local_search([list(b) for b in start], lengths)
        assert sorted(i for b in bins for i in b) == list(range(1500)) and max(fills(bins)) <= 1024
        assert len(bins) <= len(start) and (len(bins) < len(start) or sum(f * f for f in fills(bins)) >= sum(f * f for f in before))
        assert len(bins) <= slack * lengths.sum() / 1024 + 1
    # three for two: moving alone can't empty the last bin
    lengths = np.array([600, 500, 424, 400, 124])
    assert len(packing.local_search([[0, 3], [1, 2], [4]], lengths)) == 2


def improving(bins, lengths, size):
    """Brute force: a move or swap of one or two for one into a bin at least as full, or None."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, low in enumerate(bins):
        groups = [g for n in (1, 2) for g in combinations(low, n)]
        for b, other in enumerate(bins):
            if a == b or fill[a] == size or fill[b] == size or fill[b] < fill[a]:
                continue
            for g in groups:
                for back in [(), *((i,) for i in other)]:
                    gain = sum(lengths[i] for i in g) - sum(lengths[i] for i in back)
                    if (back or len(g) == 1) and 0 < gain <= size - fill[b]:
                        return g, back
    return None


def test_packing_search_ends_at_an_optimum():
    rng = np.random.default_rng(7)
    for k in range(40):
        size = int(rng.integers(8, 60))
        lengths = rng.integers(1, size + 1, int(rng.integers(0, 40)))
        start = packing.best_fit(lengths, size) if k % 2 else [[i] for i in range(len(lengths))]
        bins = packing.local_search([list(b) for b in start], lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= size for b in bins) and len(bins) <= len(start)
        assert improving(bins, lengths, size) is None


def test_packing_does_not_depend_on_partitions(spark):
    """Halves and quarters of sequences that lie in partitions of their own still meet."""
    words = {100: " a" * 99, 411: " a" * 410, 513: " a" * 512}
    texts = [words[n] for n in (100, 411, 513) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = packing.pack(df.repartitionByRange(6, "doc_id")).collect()
    assert sorted(p.length for p in found) == [100] * 10 + [411] * 10 + [513] * 10
    assert len({p.sequence_id for p in found}) == 10


# 7 near duplicates


def brute_components(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, rows, nothing):
    expected = brute_components(rows)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_beyond_the_hub(spark):
    """A chain of small edits: the hub is too far from most, which only open buckets bring together."""
    rng = random.Random(11)
    words, chain = [f"v{k}" for k in range(200)], []
    for step in range(14):
        for k in rng.sample(range(200), 3):
            words[k] = f"s{step}k{k}"
        chain.append((100 - step, " ".join(words), "en", "s", 0))
    chain.append((500, None, "en", "s", 0))
    null_id = [(None, chain[0][1], "en", "s", 0)]
    found = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame([*chain, *null_id], SCHEMA)).collect()}
    for i, e in brute_components(chain).items():
        assert (found[i].n_shingles, found[i].component_id) == e
    assert found[None].component_id is None and found[None].kept


def test_odd_sketch_estimates():
    rng = np.random.default_rng(8)
    for j in (0.75, 0.9, 1.0):
        counts = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
            n = 500
            shared = round(2 * n * j / (1 + j))
            a, b = pool[:n], np.concatenate((pool[:shared], pool[n : 2 * n - shared]))
            x, y = (neardup.odd_sketch(neardup.minhash(np.unique(v))) for v in (a, b))
            counts.append(int(np.bitwise_count(x ^ y).sum()))
        assert max(counts) <= neardup.most_different()
        mean = np.mean(counts)
        estimate = 1 + neardup.SKETCH_BITS / (4 * 128) * np.log(1 - 2 * mean / neardup.SKETCH_BITS)
        assert abs(estimate - j) < 0.04


# 8 urls


def test_urls(spark):
    urls = ["https://www.Example.COM/en/7x", "http://a.example.com/en/1", "http://b.net/de/80?x", "http://c.example.net/de/8", "http://xorg/es/", "ftp://o.org/es/1#f", None, "no scheme", "http://plain.net/?q://z/en/"]
    pages = clash(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge(pages).collect()}
    assert found[0] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert found[2] == ("b.net", "/de/80", "net/de/", "allow")
    assert found[3] == ("c.example.net", "/de/8", "example.net/de/8", "block")
    assert found[4] == ("xorg", "/es/", None, "allow") and found[5][2] == "org/es/"
    assert found[6] == ("", "", None, "allow") == found[7] and found[8][:3] == ("plain.net", "/", None)


def test_link_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.net/de/1", link("friend.test", "friend.test", "good.net")), (2, "http://friend.test/", link("far.test")), (3, "http://bad.com/en/1", ""), (4, "http://spam.test/", link("bad.com")), (5, "http://far.test/", None), (6, "http://lone.test/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {tuple(r) for r in urlgraph.host_edges(pages.select(urlgraph.host_of(F.col("url")).alias("host"), "html")).collect()} == {("good.net", "friend.test", 2), ("friend.test", "far.test", 1), ("spam.test", "bad.com", 1)}
    found = {r.host: r for r in urlgraph.judge(pages).collect()}
    assert found["friend.test"].trust > found["far.test"].trust > 0 and found["spam.test"].verdict == "block"
    assert found["lone.test"].verdict == "allow" and found["friend.test"].verdict == "allow"

    def pagerank(edges, seeds):
        rank = dict(seeds)
        for _ in range(urlgraph.ROUNDS):
            new = Counter()
            kept = 0.0
            for a in {s for s, _, _ in edges}:
                total = sum(n for s, _, n in edges if s == a)
                for s, d, n in edges:
                    if s == a and a in rank:
                        new[d] += rank[a] * n / total
                        kept += rank[a] * n / total
            back = 0.15 + 0.85 * max(0.0, 1 - kept)
            rank = {h: 0.85 * new[h] + back * seeds.get(h, 0.0) for h in {*new, *seeds}}
        return rank

    edges = [("good.net", "friend.test", 2), ("friend.test", "far.test", 1), ("spam.test", "bad.com", 1)]
    for host, value in pagerank(edges, {"good.net": 1.0}).items():
        assert abs(found[host].trust - value) < 1e-8
    assert urlgraph.judge(pages.limit(0)).count() == 0
    # repeated rows count as often as they occur, here all alike
    twice = {(r.host, r.verdict, round(r.trust, 9)) for r in urlgraph.judge(pages.union(pages)).collect()}
    assert twice == {(r.host, r.verdict, round(r.trust, 9)) for r in found.values()}


def test_small_ranks_still_block(spark):
    """A restart of a hundredth and shares of a hundredth leave little rank, which is all there is."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(k, f"http://bad{k}.com/en/", "") for k in range(100)]
    rows += [(200, "http://near.test/", link("bad0.com", *(f"other{k}.test" for k in range(99)))), (201, "http://far.test/", link("near.test", *(f"more{k}.test" for k in range(99))))]
    found = {r.host: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found["near.test"].verdict == found["far.test"].verdict == "block" and found["far.test"].trust == 0


# 9 language


def test_language(spark, docs, nothing):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "mi", "to", "ru", "shi"], "bb": ["gren", "sch", "ung", "keit", "ver"], "cc": ["oux", "eau", "que", "ille", "ment"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(4, 120)), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.filter("doc_id % 5 <> 0"))
    assert sorted(model) == ["aa", "bb", "cc"] and all(len(d) <= langid.DICT_BYTES for d in model.values())
    found = {r.doc_id: r for r in langid.classify(df.drop("lang"), model).collect()}
    held = [found[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0]
    assert sum(held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    odd = clash(spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, make("bb", 30_000))], "doc_id long, text string"))
    out = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.classify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", True) and out[4] == ("bb", False)
    assert langid.learn(df.limit(0)) == {} and langid.Classifier({})("text") == ("und", 0.0, True)
    assert langid.classify(docs, model).count() == docs.count() and langid.classify(nothing, model).count() == 0


def test_language_is_the_smallest_encoding(spark):
    import zstandard

    rng = random.Random(14)
    parts = {"aa": ["ka", "mi", "to"], "bb": ["gren", "sch", "ung"], "cc": ["oux", "eau", "ka"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5)))
    model = {lang: " ".join(word(lang) for _ in range(300)).encode() for lang in parts}
    judge = langid.Classifier(model)
    for _ in range(60):
        lang = rng.choice(list(parts))
        text = " ".join(word(lang).title() for _ in range(rng.randrange(1, 900)))
        data, sizes = text.lower().encode(), {}
        for name, held in model.items():
            raw = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=langid.LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            coder = zstandard.ZstdCompressor(dict_data=raw, compression_params=params)
            sizes[name] = sum(len(coder.compress(data[k : k + langid.CHUNK])) for k in range(0, len(data), langid.CHUNK))
        best, second = sorted(sizes.values())[:2]
        got, score, rejected = judge(text)
        if second - best >= max(1, langid.MARGIN * best):
            assert sizes[got] == best and not rejected and score == second / (best + second)


def test_more_languages_than_can_be_told(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 2)
    df = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(df)
    assert sorted(langid.learn(df.filter("doc_id < 2"))) == ["l0", "l1"]


# 10 decontamination


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(k, f"{sentence(rng, 18, 3000)}. {sentence(rng, 12, 3000)}?\n{sentence(rng, 9, 3000)}." if k % 2 else f"{sentence(rng, 14, 3000)}. {sentence(rng, 10, 3000)}.") for k in range(60)]


def test_wand_retrieves_all(items):
    index = decontam.Index(items, 0.3)
    rng = random.Random(12)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.keys)), 60)) + [t for t in range(len(index.keys)) if index.postings[t][0][0] == rng.randrange(60)]
        terms = sorted(set(terms))
        scores = Counter()
        for t in terms:
            for i, w in zip(index.postings[t][0], index.postings[t][1], strict=True):
                scores[i] += w
        assert {i: pytest.approx(s) for i, s in scores.items() if s >= 0.3 - 1e-9} == index.wand(terms)


def test_decontamination(spark, docs, items, nothing):
    rng = random.Random(13)
    bench = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    texts, expected = [], set()
    for i in range(60):
        body = sentence(rng, 150, 3000).split()
        if i % 3 == 0:
            k = rng.randrange(60)
            at = rng.randrange(len(body))
            body[at:at] = items[k][1].upper().split() if i % 2 else items[k][1].split()
            expected.add((i, k))
        elif i % 3 == 1:  # a phrase is no leak
            body[40:40] = items[rng.randrange(60)][1].split()[:6]
        texts.append((i, " ".join(body)))
    df = spark.createDataFrame([*texts, (100, None), (101, "")], "doc_id long, text string")
    assert set(got(decontam.leaks(df, bench), "doc_id", "item_id")) == expected
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(nothing, bench).count() == 0
    assert decontam.contaminate(docs, bench).count() == docs.count()


def test_index_blocks(spark, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    assert set(got(decontam.leaks(df, bench), "doc_id", "item_id")) == {(k, k) for k, _ in items}


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    texts = [f"{' '.join(f'u{k}x{j}' for j in range(20))} as all of them close" for k in range(60)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(t.split()[5:])) for k, t in enumerate(texts)], "doc_id long, text string")
    whole = got(decontam.leaks(df, bench), "doc_id", "item_id", "score")
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert whole and sorted(got(decontam.leaks(df, bench), "doc_id", "item_id", "score")) == sorted(whole)


def test_long_items_are_found_at_any_offset(spark, items):
    """Longer than two old passages, and longer than one at an offset that straddled two."""
    rng = random.Random(17)
    long = [(1000 + n, " ".join(f"q{n}x{rng.randrange(5000)}" for _ in range(n)) + ". " + " ".join(f"a{n}x{k}" for k in range(n))) for n in (450, 1500, 4000)]
    bench = spark.createDataFrame([*items, *long], "item_id long, text string")
    offsets = (0, 77, 500, 1023, 3001)
    docs = [(10 * k + j, " ".join(["pad"] * at + [text] + ["pad"] * 2000)) for k, (_, text) in enumerate(long) for j, at in enumerate(offsets)]
    docs += [(900, " ".join(long[1][1].split()[:1500])), (901, f"pad {items[0][1]} pad")]  # a question alone is no leak
    expected = {(10 * k + j, i) for k, (i, _) in enumerate(long) for j in range(len(offsets))} | {(901, items[0][0])}
    assert set(got(decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench), "doc_id", "item_id")) == expected


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    words = {"en": [f"the{k}ing" for k in range(300)], "de": [f"der{k}ung" for k in range(300)]}
    bench = [(k, " ".join(rng.sample(words["en"], 25)) + ". " + " ".join(rng.sample(words["en"], 10)) + ".") for k in range(5)]
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        rows.append([i, " ".join(rng.choice(words[lang]) for _ in range(120)), lang, "s", 0])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[5][1].replace(rows[5][1].split()[60], "other", 1)
    rows[20][1] += " " + bench[2][1]
    rows[30][1] += " reach me at someone@mail.org"
    rows += [[80, "123 456", "en", "s", 0], [81, None, None, "s", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    path = str(tmp_path)
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()}
    assert kept == set(range(80)) - {10, 11, 20}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    clean = {r.doc_id: r for r in docs.collect()}
    assert clean[30].text.endswith("reach me at [EMAIL]") and clean[30].n_chars == len(clean[30].text)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Empty, repeated, without languages, with columns called like an operator's."""
    import corpus_pipeline

    rng = random.Random(22)
    spark.createDataFrame([(1, f"{sentence(rng, 20)}. {sentence(rng, 9)}.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [sentence(rng, 60) for _ in range(6)]
    some = [(k, t, None, "s", len(t)) for k, t in enumerate(texts)]
    for name, rows, ids in (("empty", [], set()), ("plain", [*some, some[2], some[3], (None, texts[0], None, "s", 1)], {None, *range(6)})):
        docs = clash(spark.createDataFrame(rows, SCHEMA))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == ids and {r.spans for r in docs.collect()} <= {"x"}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert Counter(r.doc_id for r in packed.collect()) == Counter(r.doc_id for r in docs.collect())


def test_packing_text_column(spark):
    empty = spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string")
    assert sorted(got(packing.pack(empty), "length")) == [(1,), (2,)]
