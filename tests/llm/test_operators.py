"""Every operator against brute force, an exact round trip or held-out accuracy, and its defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, TEXT2 string"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota", "the", "of", "and", "to", "in"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x", ","]) for _ in range(n))


def corpus(spark, n=60, seed=5):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 80)), "en", f"s{i % 3}", "x") for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", ""), (n + 2, " \t\n", "en", None, ""), (n + 3, rows[0][1], "en", "s1", ""), (n + 4, rows[0][1], "en", "s1", ""), (n + 5, "word " * 30000, "en", "s2", "")]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Byte kernels.


def test_word_hashes_agree_with_a_plain_split(monkeypatch):
    from tidemark.llm import _bytes as B

    monkeypatch.setattr(B, "BLOCK", 32)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t") for _ in range(rng.choice([0, 1, 7, 40, 200]))) for _ in range(200)] + [None, "x" * 300]
    h, at = B.word_hashes(*B.texts(pa.array(texts)), B.WHITE)
    for i, t in enumerate(texts):
        assert [int(x) for x in h[at[i] : at[i + 1]]] == [B.hash_of(w) for w in split(t)]


# 1


def test_language_id_learns_words_and_backs_off(spark):
    from tidemark.llm.langid import Model, identify

    rng = random.Random(2)
    make = lambda stems: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(40))
    stems = {"aa": ["kro", "plin", "stra", "mut"], "bb": ["elle", "oui", "aux", "ment"]}
    rows = [(i, make(stems[k]), k, "", "") for i in range(60) for k in ("aa", "bb")]
    held = [(1000 + 2 * i + j, make(stems[k]) + " zz", k, "", "") for i in range(20) for j, k in enumerate(("aa", "bb"))]
    odd = [(2000, None, "aa", "", ""), (2001, "", None, "", ""), (2002, "12 !! 34", "bb", "", ""), (2003, "ellement" * 200000, "bb", "", "")]
    df = spark.createDataFrame(rows + held + odd, DOCS)
    got = {r.doc_id: r for r in identify(df, learn=lambda i: i < 1000).collect()}
    assert all(got[h[0]].lang_pred == h[2] for h in held)
    assert got[2000].lang_pred == got[2001].lang_pred == got[2002].lang_pred == "und" and got[2000].score == 0
    assert got[2003].lang_pred == "bb" and 0 <= got[2003].score <= 1
    assert identify(empty(spark)).count() == 0
    m = Model.of({"aa": {"krokro": 5}, "bb": {"ouioui": 5}})
    assert m.predict(["krox", "ouix", "krokro"])[0] == ["aa", "bb", "aa"]


def back_off_by_hand(model, words):
    """Best language of the words: their log frequency, or the mean of the longest known n-grams at each place."""
    from tidemark.llm.langid import _hashes

    known = dict(zip(model.word_keys.tolist(), model.word_logs.astype(float)))
    grams = dict(zip(model.gram_keys.tolist(), model.gram_logs.astype(float)))
    total = np.zeros(len(model.languages))
    for w in words:
        h = int(_hashes([w])[0])
        if h in known:
            total += known[h]
            continue
        padded, met = f" {w} ", []
        for i in range(len(padded)):
            for k in range(min(5, len(padded) - i), 0, -1):
                g = int(_hashes([padded[i : i + k]])[0])
                if g in grams:
                    met.append(grams[g])
                    break
        if met:
            total += np.mean(met, axis=0)
    return model.languages[int(total.argmax())]


def test_language_id_is_that_of_plain_python_and_loses_no_key(spark):
    from tidemark.llm import langid as L

    rng = random.Random(21)
    stems = {"aa": ["kro", "plin", "stra", "mut", "é"], "bb": ["elle", "oui", "aux", "kro", "ö"], "cc": ["zor", "plin", "nim"]}
    make = lambda k, n=25: " ".join(rng.choice(stems[k]) + rng.choice(stems[k]) + rng.choice(stems[k]) for _ in range(n))
    rows = [(i, make(k), k, None, None) for i in range(30) for k in stems]
    model = L.fit(spark.createDataFrame([r[:3] for r in rows], "id long, text string, lang string"), words=20, grams=60)
    tests = [make(k, rng.randint(1, 12)) for k in stems for _ in range(40)]
    got = model.predict(tests)[0]
    assert sum(a == back_off_by_hand(model, t.split()) for a, t in zip(got, tests)) == len(tests)
    # Counts made by the executors are those of plain Python.
    counts = {k: Counter(w for r in rows if r[2] == k for w in r[1].split()) for k in stems}
    whole, plain = L.fit(spark.createDataFrame([r[:3] for r in rows], "id long, text string, lang string")), L.Model.of(counts)
    for a, b in (("word_keys", "word_logs"), ("gram_keys", "gram_logs")):
        x, y = (dict(zip(getattr(m, a).tolist(), getattr(m, b).tolist())) for m in (whole, plain))
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k]) for k in x)
    keys = np.random.default_rng(0).integers(0, 2**63, 200_000, np.uint64) * np.uint64(2)
    assert (L._Lookup(keys)(keys) == np.arange(len(keys))).all() and (L._Lookup(keys)(keys + np.uint64(1)) == -1).all()


# 2


def test_templates_fold_and_refuse():
    from tidemark.llm import chat as T

    body = T.fold_body(T.parse("a{{ 'b' ~ 'c' | upper }}{% if 1 == 1 %}d{% else %}e{% endif %}{# no #}"))
    assert len(body) == 1 and body[0].of.value == "abCd"
    render = T.compile_template("{% for t in turns %}{% if loop.first %}<{% endif %}{{ t.role if t.role else 'none' }}{% set n = t.text | length %}{{ n }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert render([{"role": "a", "text": "xy"}, {"role": "", "text": ""}])[0] == "<a2,none0"
    either = T.compile_template("{% if long %}{% for t in turns %}{{ t.text }}.{% endfor %}{% else %}{% for t in turns %}{{ t.text }},{% endfor %}{% endif %}")
    assert either([{"role": "", "text": "x"}] * 2, long=True)[0] == "x.x." and either([{"role": "", "text": "x"}])[0] == "x,"
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{{ x | nope }}", "{% for x in y %}{% endfor %}", "{% if a %}", "{{ 1 + }}", "a {{ b", "{% if a", "{% if a %}b{% else if c %}d{% endif %}", "{% if a %}b{% else %}c{% else %}d{% endif %}", "{% for t in turns %}a{% endfor x %}", "{% for t in turns %}a{% endfor %}{% for t in turns %}b{% endfor %}", "{% for t in turns %}{% for u in turns %}b{% endfor %}{% endfor %}"):
        with pytest.raises(T.TemplateError):
            T.compile_template(bad)


def test_escape_is_reversible_and_conversations_read_back(spark):
    from tidemark.llm import chat as T

    rng = random.Random(3)
    for _ in range(500):
        s = "".join(rng.choice(["\\", "#", "###", "</turn>", "\n", ":", "a", "### ", "é"]) for _ in range(rng.randint(0, 12)))
        render = T.compile_template()
        text, spans = render([{"role": s, "text": s}, {"role": "assistant", "text": s}])
        assert T.read_back(text) == [(s, s), ("assistant", s)]
        assert [T.unescape(text[a:b]) for a, b in spans] == [s]
    rows = [(1, 1, "assistant", "x"), (1, 0, "user", None), (2, 0, None, ""), (None, 0, "user", "n"), (1, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in T.format_conversations(T.with_mark_conversation(df)).collect()}
    assert T.read_back(got[1].formatted) == [("user", ""), ("assistant", "x"), ("assistant", "x")]
    assert T.read_back(got[-7].formatted) == [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert T.read_back(got[2].formatted) == [("", "")] and T.read_back(got[None].formatted) == [("user", "n")]
    assert T.format_conversations(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


# 3


def test_hamming_search_is_exact(spark, monkeypatch):
    from tidemark.llm.hamming import Index, search_vectors

    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 70))
    vecs = [base[i % 40] + rng.normal(size=70) * (0.0 if i % 3 else 0.7) for i in range(300)]
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(vecs)] + [(301, None), (302, []), (303, vecs[0].tolist()), (None, vecs[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    monkeypatch.setattr("tidemark.llm.hamming.SHARD_CODES", 30)  # several shards
    for r in search_vectors(df, lambda i: i % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    bits = {i: np.array(v) > 0 for i, v in rows if i is not None and v}
    for q in (i for i in bits if i % 20 == 0):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    codes = rng.integers(0, 2**16, (500, 1)).astype(np.uint64)
    index = Index(codes, np.arange(500), 64)
    for q in codes[:20] ^ np.uint64(5):
        d = np.bitwise_count(codes[:, 0] ^ q[0])
        assert index.search(q, 7)[1].tolist() == sorted(d.tolist())[:7]
    assert search_vectors(df.limit(0), lambda i: i % 20 == 0).count() == 0


# 4


def test_quality_separates_faults_without_labels(spark):
    from tidemark.llm.quality import classify, fit_labellers

    rng = random.Random(6)
    good = [(i, sentence(rng, 60) + ".", "en", "", "") for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 60).split()), "en", "", "") for i in range(25)]
    bad += [(2000 + i, " ".join([rng.choice(WORDS)] * 60), "en", "", "") for i in range(25)]
    df = spark.createDataFrame(good + bad + [(5000, None, "", "", ""), (5001, " ", "", "", "")], DOCS)
    got = {r.doc_id: r for r in classify(df, carry=("text", "source")).collect()}
    assert sum(got[r[0]].kept for r in good) >= 195 and sum(got[r[0]].kept for r in bad) <= 2
    assert not got[5000].kept and got[5001].score == 0
    assert got[3].text == good[3][1]
    assert classify(empty(spark)).count() == 0


def test_em_beats_any_rule_fired():
    """Noisy labellers of two kinds of bad documents, some of which see both: EM must find the kinds and weigh the votes."""
    from tidemark.llm.quality import fit_labellers

    g = np.random.default_rng(0)
    n = 40_000
    kind = g.choice(3, n, p=[0.8, 0.12, 0.08])  # good, and two kinds of bad
    fires = np.array([[0.04] * 8, [0.8, 0.7, 0.75, 0.6, 0.05, 0.05, 0.5, 0.05], [0.05, 0.05, 0.05, 0.05, 0.8, 0.75, 0.6, 0.65]])
    v = (g.random((n, 8)) >= fires[kind]).astype(int)  # 0 is a bad vote
    v[g.random((n, 8)) < 0.1] = 2  # abstains
    pats, inv, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = fit_labellers(pats, counts.astype(float))
    said = model["posterior"][inv.ravel()] >= 0.5
    em, fired = ((x == (kind == 0)).mean() for x in (said, ~(v == 0).any(axis=1)))
    majority = ((v == 0).sum(axis=1) < (v == 1).sum(axis=1)) == (kind == 0)
    assert em > 0.95 > max(fired, majority.mean()) + 0.02
    assert abs(model["share"][0] - 0.8) < 0.03 and np.abs(model["table"][0, :, 0] - 0.04).max() < 0.03
    truth = np.array([(np.where(kind == 0, 1, 0)[v[:, j] != 2] == v[v[:, j] != 2, j]).mean() for j in range(8)])
    assert np.abs(model["accuracy"] - truth).max() < 0.03


# 5


def test_packing_is_gapless_and_near_the_optimum(spark):
    from tidemark.llm.packing import cut, pack_documents, plan

    assert cut(5, 1024) == [(0, 5)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)] and cut(1500, 1024) == [(0, 476), (476, 1024)]
    rng = random.Random(7)
    counts = Counter(rng.randint(1, 1024) for _ in range(5000))
    slots, used = plan(counts)
    assert sum(n1 - n0 for _, n0, n1, _, _ in slots) == 5000
    assert used <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 1024)
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = corpus(spark)
    out = pack_documents(df).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code = lambda texts: [plain.encode(t, add_special_tokens=False).ids for t in texts]
    by_id = {}
    for r in out.itertuples():
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        ids = [*code([text or ""])[0], 2]
        ps = sorted(by_id[i], key=lambda r: r.piece)
        assert [x for p in ps for x in p.ids] == ids and [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert pack_documents(empty(spark)).count() == 0


def test_ranks_and_tokenizer_give_the_same_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import _encoder

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    chars = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "漢", "🙂", "1", "23", "'s", "'", "<|endoftext|>", "###", " ", "ing", "The", "\x00", "﻿"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["x" * 5000, "ab" * 3000, " " * 4000]
    for added in ("ids", "text"):
        t.encode_special_tokens = added == "text"
        assert _encoder("byte_bpe_50k.json", added)(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert _encoder("byte_bpe_50k.json", "ids")(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


# 6


def test_toxicity_on_held_out_rows(spark):
    from tidemark.llm import toxicity as T

    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(rng, 30).split() + (["grumblewort"] if toxic else []) + (["muslim"] if toxic and i % 8 == 0 else [])
        rng.shuffle(words)
        texts.append((i, " ".join(words), "en", "", ""))
        labels.append((i, int(toxic)))
    texts += [(900, "a neutral note about muslim neighbours", "", "", ""), (901, None, "", "", ""), (902, "", "", "", "")]
    docs, known = spark.createDataFrame(texts, DOCS), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, known, learn=lambda i: i % 5 != 0).collect()}
    held = [(got[i].predicted, y) for i, y in labels if i % 5 == 0]
    assert all(p == y for p, y in held)
    assert got[900].predicted == 0 and got[901].score == got[902].score
    assert T.score_toxicity(empty(spark), known).count() == 0
    assert T.score_toxicity(docs, empty(spark, "doc_id long, toxic int")).agg(F.max("score")).first()[0] < 1e-6


def test_swapping_identity_terms_takes_false_positives_away(spark, monkeypatch):
    """A group's name stands in most toxic texts: the plain model blames it, the counterfactual one does not."""
    from tidemark.llm import toxicity as T

    rng = random.Random(14)
    rude = ["".join(rng.choice("bdfgklmnprst" if k % 2 else "aeiou") for k in range(8)) for _ in range(25)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = sentence(rng, 20).split()
        words += [rng.choice(rude)] * toxic + ["muslim"] * (rng.random() < (0.9 if toxic else 0.02))
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "", ""))
        labels.append((i, int(toxic)))
    neutral = [(1000 + i, sentence(rng, 20) + " muslim neighbours " + sentence(rng, 5), "en", "", "") for i in range(50)]
    toxic = [(2000 + i, sentence(rng, 20) + f" {rng.choice(rude)} {rng.choice(['', 'muslim', 'hindu'])}", "en", "", "") for i in range(50)]
    docs, known = spark.createDataFrame(rows + neutral + toxic, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")

    def wrong(**more):
        got = {r.doc_id: r.predicted for r in T.score_toxicity(docs, known, **more).collect()}
        return sum(got[r[0]] for r in neutral), sum(1 - got[r[0]] for r in toxic)

    plain, fair = wrong(terms={}), wrong()
    assert plain[0] >= 25 and fair[0] == 0 and fair[1] <= 5
    # The slot of a term is bound even where no labelled text names a group but its hash meets another word's.
    kinds = T.term_hashes({"faith": "muslim hindu"})
    pairs = T.counterfactuals([np.empty(0, np.uint64)] * 6, kinds)
    (a, b) = (T._slot(t) for t in kinds["faith"])
    assert sum(w for *_, w in pairs) == pytest.approx(1) and {p[:2] for p in pairs} == {((), (a,)), ((), (b,)), ((a,), (b,)), ((b,), (a,))}


def test_no_feature_is_screened_out_for_good():
    """A word that only matters once another one is accounted for gains its weight all the same."""
    from tidemark.llm import toxicity as T

    g = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        a, b = g.random() < 0.5, g.random() < 0.5
        y = int(g.random() < 1 / (1 + np.exp(-(3.0 * a + 3.0 * b - 3.0 * (a or b) - 1.0))))
        rows.append((y, 1.0, np.flatnonzero([a, b, a or b, g.random() < 0.3])))
    w = T.fit(rows, [], lasso=1e-4)
    y, x = np.array([r[0] for r in rows]), np.zeros((4000, 4))
    for i, r in enumerate(rows):
        x[i, r[2]] = 1
    p = 1 / (1 + np.exp(-(x @ w[:4] + w[-1])))
    pull = np.abs((p - y) @ x) / 4000
    assert (pull <= 1e-4 * (x.mean(axis=0) + 1e-3) ** 0.25 * 1.5 + 1e-5 + 0.01 * (w[:4] != 0)).all()


# 7


def test_html_main_text(spark):
    from tidemark.llm.html_extract import extract, main_texts

    para = "This is the first paragraph of the article and it is long enough to be good with the words of the language in it, as it was for the one before it. " * 2
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div id=content><h2>Head &amp; tail</h2><p>{para}</p><p>Short&nbsp;one.<br>x</p><p>{para}</p></div><div class='sidebar'><p>{para}</p></div><div class=comments><p>{para}</p></div><form><p>{para}</p></form><script>var p = '<p>no</p>';</script><footer><p>&copy; me</p></footer>"
    want = " ".join(para.split())
    assert extract(page) == f"Head & tail\n{want}\nShort one. x\n{want}"
    assert extract("<body><div class=ad>Buy</div><article><h1>A &am</h1><p><b>x.<br><p>y</p></article><footer>f") == "A &am\nx.\ny"
    assert extract(None) == extract("") == extract("<nav>a</nav>") == ""
    assert extract(f"<div class='layout with-sidebar'><h2>T</h2><p>{para}</p></div>") == f"T\n{want}"
    assert extract(f"<div class=header><p>{para}</p></div><article><p title=it's>{para}</p><article class='comment'><p>{para}</p></article></article>") == want
    assert extract("<div class=menu>x</div>" * 3) in ("", "x\nx\nx")
    rows = [(1, "u", page), (2, None, None), (1, "u", page)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


# 8


def test_syncmers_against_brute_force(spark):
    import xxhash

    from tidemark.llm.syncmers import TOKEN, fingerprint_edits, with_anchors

    df, rows = corpus(spark, 30)
    ids = lambda x: int.from_bytes(x.to_bytes(8, "little", signed=x < 0), "little")
    long_ = lambda v, seed: xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    pattern = re.compile(TOKEN.replace("\\u0E00-\\u0E7F\\u2E80-\\u9FFF\\uAC00-\\uD7AF", "฀-๿⺀-鿿가-힯"))
    for r in with_anchors(df).collect():
        h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in pattern.findall(r.text or "")]
        g = [long_(b, long_(a, 42)) for a, b in zip(h, h[1:])]
        want = []
        for i in range(len(g) - 3):
            a, b, c, d = (signed(x) for x in g[i : i + 4])
            if min(a, d) <= min(b, c):
                want.append((i + 1, long_(ids(d), long_(ids(c), long_(ids(a), 42))) >> 24))
        if len(h) >= 5:
            assert [(x.place, x.hash) for x in r.anchors] == want
        else:
            assert len(r.anchors) == (1 if h else 0)
    out = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (k, text, *_) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        assert out[k].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()
        assert out[k].n_chars == len(text) and 0 <= out[k].near_edited <= 1 and 0 <= out[k].near_next <= 1
    assert out[33].fingerprint == out[34].fingerprint == out[0].fingerprint and out[31].fingerprint == ""
    assert fingerprint_edits(empty(spark)).count() == 0
    assert len(fingerprint_edits(df.limit(1)).collect()) == 1


@pytest.mark.parametrize("kind", ["sparse", "dense", "null", "repeated"])
def test_next_rows_do_not_hang_on_how_ids_are_spread(spark, monkeypatch, kind):
    from tidemark.llm import syncmers as M

    monkeypatch.setattr(M, "RANGE_ROWS", 8)
    rng = random.Random(15)
    ids = {"sparse": [rng.randrange(-(2**62), 2**62) for _ in range(90)], "dense": list(range(90)), "null": [None] * 40 + list(range(50)), "repeated": [5] * 60 + list(range(30))}[kind]
    rows = [(i, sentence(rng, 6), "", "", "") for i in ids]
    df = spark.createDataFrame(rows, DOCS)
    import xxhash

    tie = lambda t: (lambda v: v - 2**64 if v >= 2**63 else v)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], tie(r[1])))
    want = []
    for i, (k, text, *_) in enumerate(order):
        cut, nxt = len(text) // 3, order[(i + 1) % len(order)][1]
        want.append((str(k), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()))
    got = M.fingerprint_edits(df).select("doc_id", "edited_sha256").collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)
    keyed = df.selectExpr("coalesce(doc_id, -9223372036854775808) as at", "xxhash64(text) as tie")
    sizes = [r["count"] for r in M._with_ranges(keyed, *M._ranges(keyed.select("at"))).groupBy("range", "part").count().collect()]
    assert max(sizes) <= 24 and sum(sizes) == 90


# 9


def test_mix_meets_targets(spark):
    from tidemark.llm.mixing import mix_sources

    df, rows = corpus(spark, 200)
    df, rows = df.where("doc_id <> 205"), rows[:-1]  # a document larger than all others cannot be taken in part
    out = mix_sources(df).toPandas()
    assert len(out) == len(rows)
    size = {i: len(split(t)) for i, t, *_ in rows}
    assert all(size[r.doc_id] == r.size for r in out.itertuples())
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = dict(zip(sources, [5, 2, 1, 5]))
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3.0 * total[s] for s in over)
        open_ -= over
    for s, g in out.groupby(out.source.fillna("~none")):
        s = None if s == "~none" else s
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 * max(1, target[s])
        assert (g.taken <= 3 * g["size"]).all()
        if len(g) > 5:
            assert abs(g.taken.sum() - target[s]) <= max(0.01 * target[s], 60)
    again = mix_sources(df.repartition(3)).toPandas()
    assert sorted(out[["doc_id", "taken"]].itertuples(index=False)) == sorted(again[["doc_id", "taken"]].itertuples(index=False))
    assert mix_sources(empty(spark)).count() == 0


def mix_by_brute_force(rows, targets):
    """Words taken of each row (source, size, key, id, mark): keys in order while they fit, then the size nearest to the gap."""
    out = [0] * len(rows)
    for source, (size, target) in targets.items():
        own = sorted((i for i, r in enumerate(rows) if r[0] == source), key=lambda i: (rows[i][2], rows[i][3], rows[i][4]))
        epochs = int(target / size + 1e-12) if size else 0
        rest, run, left = target - epochs * size, 0, []
        gap = rest
        for i in own:
            run += rows[i][1]
            out[i] = epochs * rows[i][1]
            if run <= rest:
                out[i] += rows[i][1]
                gap -= rows[i][1]
            elif rows[i][1]:
                left.append(i)
        near = [i for i in left if abs(rows[i][1] - gap) < gap]
        if near:
            best = min(near, key=lambda i: (abs(rows[i][1] - gap), rows[i][2], rows[i][3], rows[i][4]))
            out[best] += rows[best][1]
    return out


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_mix_takes_the_least_keys_and_one_closing_row(spark, monkeypatch, slice_rows):
    import math

    from tidemark.llm import mixing as M

    monkeypatch.setattr(M, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(M, "BLOCK_SLICES", 4)
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randint(3, 40)) + " #" * rng.randint(0, 60), "en", f"s{i % 4}", "") for i in range(400)]
    rows += [(900, "five words are in this", "", "s0", "")] * 12 + [(None, sentence(rng, 9), "", "s1", "")] * 3
    out = M.mix_sources(spark.createDataFrame(rows, DOCS)).collect()

    def digest(r):
        return int(hashlib.md5("\x1f".join(["\x1e" if r[0] is None else str(r[0]), r[1], r[3], "17"]).encode()).hexdigest()[:15], 16)

    odd = set("0123456789#$%&*|!<>{}[]()=+/\\_~^@\"'")
    facts = []
    for r in rows:
        quality = max(sum(c not in odd for c in r[1]) / len(r[1]), 0.05)
        facts.append((r[3], len(split(r[1])), -math.log(((digest(r) >> 7) + 1) / 2**53) / quality, -1 if r[0] is None else r[0], digest(r)))
    targets = {r.source: (r.source_size, r.target) for r in out}
    want = sorted((f[3], f[4], t) for f, t in zip(facts, mix_by_brute_force(facts, targets)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.mark, r.taken) for r in out) == want
    placed = Counter(r.source for r in out)
    assert sum(placed.values()) == len(rows)


def test_no_slice_of_keys_is_crowded_at_any_quality():
    """The largest slice of simulated keys stays near SLICE_ROWS, also where nearly all documents are poor."""
    from tidemark.llm.mixing import OCTAVE, SLICE_ROWS

    g = np.random.default_rng(3)
    n = 200_000
    for quality in (np.full(n, 1.0), np.full(n, 0.05), np.where(g.random(n) < 0.9, 0.05, 1.0)):
        key = -np.log(g.random(n)) / quality
        slices = np.floor(np.log2(np.maximum(key, 2.0**-60)) * np.ceil(n * OCTAVE / SLICE_ROWS))
        assert np.unique(slices, return_counts=True)[1].max() < 1.2 * SLICE_ROWS


# 10


def components_by_brute_force(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = split((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_are_those_of_brute_force(spark):
    from tidemark.llm.minhash import near_duplicates

    df, rows = corpus(spark, 40)
    rng = random.Random(10)
    base = sentence(rng, 90).split()
    extra = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        extra.append((500 + i, " ".join(w).upper() if i % 2 else " ".join(w), "en", "s", ""))
    rows = rows + extra
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    want = components_by_brute_force(rows)
    assert {i: v[:2] for i, v in got.items()} == want and all(v[2] == (i == v[1]) for i, v in got.items())
    assert near_duplicates(empty(spark)).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f", "", "", ""), (7, "a b c d e f", "", "", ""), (7, "a b c d e f", "", "", "")], DOCS)
    assert sorted((str(r.doc_id), r.component_id) for r in near_duplicates(one).collect()) == [("7", 7), ("7", 7), ("None", 7)]


def near_group(n, outliers, seed=13):
    """n texts of 100 words with one changed word each, and some that change two or three more."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(n + outliers):
        w = list(base)
        for _ in range(1 if i < n else rng.randint(3, 4)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", ""))
    return rows


@pytest.mark.parametrize("block", [5, 1024])
def test_members_held_apart_are_compared_in_blocks(spark, monkeypatch, block):
    from tidemark.llm import minhash as M

    monkeypatch.setattr(M, "BLOCK", block)
    rows = near_group(60, 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == components_by_brute_force(rows)


def test_comparisons_grow_with_the_group_not_with_its_square(spark, monkeypatch):
    from tidemark.llm import minhash as M

    pairs, real = [], M.written

    def seen(df, name):
        made = real(df, name)
        if name == "apart":
            pairs.append(made.agg(F.sum(F.col("minors") * F.col("crowd"))).first()[0])
        return made

    monkeypatch.setattr(M, "written", seen)
    for n in (200, 800):  # a growing group and the same few outliers
        assert len({r.component_id for r in M.near_duplicates(spark.createDataFrame(near_group(n, 8), DOCS)).collect()}) > 1
    assert pairs[1] < 7 * pairs[0]  # in proportion would be 4, all pairs 16


# Findings of the first round.


def chain_by_brute_force(a, b):
    """(place, hash) lists: k-th places of a hash paired, runs at one distance, the heaviest ascending chain, as Dice."""
    where = {}
    for k, x in enumerate(b):
        where.setdefault(x.hash, []).append(x.place)
    seen, pairs = Counter(), []
    for x in a:
        k = seen[x.hash]
        seen[x.hash] += 1
        if k < len(where.get(x.hash, [])):
            pairs.append((x.place, where[x.hash][k]))
    runs = []
    for p, q in pairs:
        if runs and runs[-1][3] == p - q:
            runs[-1][1:3] = q, runs[-1][2] + 1
        else:
            runs.append([q, q, 1, p - q])
    best = []
    for i, (low, _, n, _) in enumerate(runs):
        best.append(n + max((best[j] for j in range(i) if runs[j][1] < low), default=0))
    return 2 * max(best, default=0) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def test_fingerprints_hold_all_anchors_and_match_by_position(spark):
    from tidemark.llm.syncmers import fingerprint_edits, with_anchors

    rng = random.Random(11)
    make = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, half, other = make(60), make(1500), make(1500)
    texts = [make(900) + passage + make(1100), make(100) + passage + make(1900), half + other, other + half, ["again"] * 700, ["again", "and"] * 400]
    edited = list(half)
    for k in range(0, 1500, 100):
        edited[k : k + 1] = make(rng.randint(0, 3))
    df = spark.createDataFrame([(i, " ".join(t), "", "", "") for i, t in enumerate([*texts, half, edited])], DOCS)
    anchors = {r.doc_id: r.anchors for r in with_anchors(df).collect()}
    got = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    for i, r in got.items():
        held = r.fingerprint.split("|")[0].split(",")
        assert [(int(x[:10], 16), int(x[10:], 16)) for x in held] == [(x.hash, x.place) for x in anchors[i]]
        assert r.near_next == pytest.approx(chain_by_brute_force(anchors[i], anchors[(i - 1) % len(got)]), abs=1e-12)
    assert got[1].near_next > 0.01 and 0.45 < got[3].near_next < 0.55 and 0.9 < got[7].near_next < 1


def test_an_article_raises_blocks_but_decides_nothing_alone():
    from tidemark.llm.html_extract import extract

    para = "This is the first paragraph of the article and it is long enough to be good with the words of the language in it, as it was for the one before it. " * 2
    want = " ".join(para.split())
    card = "<article class='card'><p>A teaser of the other post that is not long, but it is a paragraph.</p></article>"
    got = extract(f"<body><div>{para}</div><div>{para}</div><div class=ad>Buy</div>{card}<div class=footer>f</div></body>")
    assert got.startswith(f"{want}\n{want}")
    # Inside an article, words and neighbours decide too: a list of numbers between adverts is no text of it.
    numbers = "<p>" + " ".join(str(1000 + i) for i in range(20)) + "</p>"
    assert extract(f"<article><p>{para}</p><div class=ad>Buy</div>{numbers}<div class=ad>Buy</div></article>") == want
    assert extract(f"<article><p>{para}</p>{numbers}<p>{para}</p></article>").count("\n") == 2


def page_of(rng, article):
    """A page of prose between a menu, an advert without a name, and a footer; paragraphs of several lengths."""
    stops = "the of and to in a is that it was for on are as with by at from this be".split()
    say = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.4 else sentence(rng, 1) for _ in range(n)).capitalize() + "."
    paras = [say(n) for n in (60, 8, 45, 14, 70)]
    body = "<h1>Alpha beta</h1>" + "".join(f"<p>{x}</p>" for x in paras)
    menu = "<div>" + "".join(f"<div><a href=x>{w}</a></div>" for w in WORDS) + "</div>"
    links = f"<div><a href=x>{say(20)}</a></div>"
    numbers = "<div>" + " ".join(str(rng.randint(100, 999)) for _ in range(30)) + "</div>"
    tag = "article" if article else "div"
    page = f"<html><body>{menu}{numbers}<{tag}>{body}</{tag}>{links}<div>&copy; us</div></body></html>"
    return page, "\n".join(["Alpha beta", *(" ".join(x.split()) for x in paras)])


def test_words_and_neighbours_decide_pages_without_an_article(monkeypatch):
    from tidemark.llm import html_extract as H

    pages = [page_of(random.Random(k), False) for k in range(30)]
    assert [H.extract(p) for p, _ in pages] == [want for _, want in pages]
    assert [H.extract(page_of(random.Random(k), True)[0]) for k in range(30)] == [want for _, want in pages]
    monkeypatch.setattr(H, "_STOPS", frozenset())
    assert not any(H.extract(p) == want for p, want in pages)


def test_broken_pages_take_time_in_proportion():
    import time

    from tidemark.llm.html_extract import extract

    def seconds(n):
        began = time.perf_counter()
        extract("<b><div>x" * n + "</i></b>y<p>z" * n + "<select>" * n + "<i>" * n + "</u>" * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.01)


# Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names.

CLASHING = "DOC_ID string, doc_id long, text string, Text int, lang string, LANG int, source string, SOURCE int, n_chars long, score int, kept int, component_id int"


def clashing(spark, rows):
    """(id, text, lang, source) rows among columns whose names differ by case or are named like results."""
    return spark.createDataFrame([("x", i, t, 1, lang, 2, s, 3, len(t or ""), 4, 5, 6) for i, t, lang, s in rows], CLASHING)


def odd_rows():
    rng = random.Random(16)
    long_ = " ".join(sentence(rng, 40) for _ in range(800))
    rows = [(i, sentence(rng, 30), "en" if i % 2 else "de", f"s{i % 2}") for i in range(40)]
    rows += [(None, None, None, None), (None, "alpha beta gamma", None, None), (100, "", "en", "s0"), (101, " \t", None, "s1"), (102, long_, "en", "s0"), (103, "x" * 300_000, "de", "s1")]
    return rows + [rows[0]] * 3


def operators(spark):
    from tidemark.llm import langid, minhash, mixing, packing, quality, syncmers, toxicity

    labels = spark.createDataFrame([(i, int(i % 3 == 0), 7) for i in range(40)] + [(None, 1, 7), (5, None, 7)], "doc_id long, toxic int, TOXIC int")
    return {
        "op1": lambda df: langid.identify(df, learn=lambda i: i < 30),
        "op4": quality.classify,
        "op5": lambda df: packing.pack_documents(df, keep_ids=False),
        "op6": lambda df: toxicity.score_toxicity(df, labels),
        "op8": syncmers.fingerprint_edits,
        "op9": mixing.mix_sources,
        "op10": minhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op6", "op8", "op9", "op10"])
def test_odd_rows_and_clashing_columns(spark, name):
    run = operators(spark)[name]
    rows = odd_rows()
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = clashing(spark, rows)
        found = [r.asDict() for r in run(df).collect()]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    if name == "op5":
        found = [r for r in found if r["piece"] == 0]
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    again = [r.asDict() for r in run(plain).collect()]
    again = [r for r in again if r.get("piece", 0) == 0]
    skip = {"sequence_id", "offset"}
    key = lambda r: sorted((k, str(v)) for k, v in r.items() if k not in skip)
    assert sorted(map(key, found)) == sorted(map(key, again))
    alike = [key(r) for r in found if r["doc_id"] == 0]
    assert len(alike) == 4 and (name in ("op8", "op9") or all(a == alike[0] for a in alike))
    assert run(plain.limit(0)).collect() == []


def test_odd_rows_of_the_other_tables(spark):
    from tidemark.llm import chat, hamming, html_extract

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        talk = spark.createDataFrame([(1, 0, "user", "a" * 500_000, 1, 2), (1, 1, "assistant", "b", 1, 2), (1, 1, "assistant", "b", 1, 2)], "conv_id long, turn long, role string, text string, TEXT int, formatted int")
        (r,) = chat.format_conversations(talk).collect()
        assert chat.read_back(r.formatted) == [("user", "a" * 500_000), ("assistant", "b"), ("assistant", "b")]
        vectors = spark.createDataFrame([(i % 50, [float(i % 7 - 3), 1.0, -1.0], "x", 1) for i in range(100)], "vec_id long, embedding array<double>, EMBEDDING string, distance int")
        got = hamming.search_vectors(vectors, lambda i: i % 20 == 0, k=3).collect()
        assert Counter(r.query_id for r in got) == {0: 3, 20: 6, 40: 3}  # id 20 has two different codes
        pages = spark.createDataFrame([(1, "u", "<p>" + "the of and to in " * 100_000 + "</p>", 1, 2), (None, None, None, 1, 2)], "page_id long, url string, html string, HTML int, text int")
        assert sorted(r.n_chars for r in html_extract.main_texts(pages).collect()) == [0, 17 * 100_000 - 1]
        assert html_extract.main_texts(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_carried_columns_may_not_take_the_names_of_results(spark):
    from tidemark.llm import langid, quality, toxicity

    df = spark.createDataFrame([(1, "a", "en", 1, 2)], "doc_id long, text string, lang string, score int, votes int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for run in (lambda c: langid.identify(df, carry=c), lambda c: quality.classify(df, carry=c), lambda c: toxicity.score_toxicity(df, labels, carry=c)):
        with pytest.raises(ValueError):
            run(("score",))


def test_tables_that_nothing_reads_are_deleted(spark):
    import os

    from tidemark.llm._common import discard, shared_dir, written
    from tidemark.llm.minhash import near_duplicates

    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    df, _ = corpus(spark, 30)
    out = near_duplicates(df)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(place)) - before}
    assert {"signed", "labels"} <= left and not left & {"held", "placed", "members", "sets", "candidates", "open", "large"}
    assert out.count() == df.count()
    table = written(df, "t")
    discard(table)
    assert not any(n.startswith("t-") for n in os.listdir(place))
    with pytest.raises(ValueError):
        discard(df)


class _Session:
    """A session without the setting for shared folders."""

    def __init__(self, master):
        self.master, self.held = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.held

    def setCheckpointDir(self, path):  # noqa: N802
        self.held = path + "/own"


def test_only_a_local_master_gets_a_folder_of_its_own():
    from tidemark.llm._common import shared_dir

    local = _Session("local[2]")
    assert shared_dir(local).startswith("file://") and shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError):
        shared_dir(_Session("spark://far:7077"))
