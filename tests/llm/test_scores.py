"""Secrets, quality and toxicity on planted texts."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, of_spark, of_sql

from complyspark.llm import quality, queries, secrets, toxicity
from complyspark.llm.labelled import isotonic
from complyspark.llm.trigrams import trigram_query

LONG = "fedcba98" * 5
TEXTS = [
    "token=secret:abcdefgh", "token=secret=abcdefgh12", 'PassWord" : "hunter2hunter2', "api_key=12345678 apikey = abcd", "AKIAAKIAAKIAAKIA", "AKIASHORT " + LONG + "z" + LONG, "nothing", "", None,
    "日本 secret='αβγ' secret='abc.def-ghi' 𝒳 " + LONG, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18, "ſecret=abcdefghij toKen:   ABCDEFGH", "secret=aaaaaaaa" * 300,
]


def base(text):
    found = []
    t = text or ""
    kinds = (("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0))
    for n, (kind, rx, least, group) in enumerate(kinds):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(rx, t) if len(m[group]) >= least]
    return sorted(found)


def test_base_spans(make_docs):
    rows = secrets.scan(make_docs(list(enumerate(TEXTS)))).collect()
    for r in rows:
        got = [(s.start, s.rule, s.end) for s in r.spans if s.rule < 3]
        assert got == [f[:3] for f in base(TEXTS[r._id])], TEXTS[r._id]
    kinds = {secrets.RULES[s.rule].kind for r in rows for s in r.spans}
    assert {"pem", "github"} <= kinds


def test_candidates_lose_nothing(make_docs):
    """Every match of an indexed rule is in a document that its query finds."""
    from complyspark.llm.common import keyed

    docs = keyed(make_docs(list(enumerate(TEXTS))), "doc_id", "text")
    found = {r._id: set(r.rules) for r in secrets.candidates(secrets.postings(docs)).collect()}
    for i, t in enumerate(TEXTS):
        for n, rule in enumerate(secrets.RULES):
            if trigram_query(rule.pattern) is not None and re.search(rule.pattern, t or ""):
                assert n in found.get(i, set())


def test_trigram_queries():
    assert trigram_query("abcd|xyz") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert trigram_query("a?bcd") == [frozenset({"bcd"})]
    assert trigram_query("ab.*cd") is None
    assert trigram_query("[0-9a-f]{32,}") is None
    assert trigram_query("(abc|de)x+") is None
    assert trigram_query("(abc|def)+") == [frozenset({"abc"}), frozenset({"def"})]


def test_redacted(make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    out = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert secrets.redacted(docs).columns == docs.columns
    assert out[6].text == "nothing" and out[8].text is None and out[7].text == ""
    assert LONG not in out[9].text and out[9].text.startswith("日本 secret='αβγ' [SECRET]") and "𝒳" in out[9].text
    assert out[9].n_chars == len(out[9].text)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_sql(connect(sf_dir), queries.SQL[name])


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, make_docs):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 500, rng.integers(20, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join([w[0]] * len(w)) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), 0))
    rows += [(9000, None), (9001, ""), (9002, " ")]
    docs = make_docs(rows)
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, _labels(spark, [*labels, (5, None, None), (None, 1, 1)]))).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y, _ in labels]) > 0.97
    none = quality.scored(docs, quality.fit(docs, _labels(spark, []))).collect()
    assert {r.score for r in none} == {0.5}


def test_isotonic():
    x, p = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(p) >= 0).all() and (np.diff(x) > 0).all()


def test_toxicity(spark, make_docs):
    rng = np.random.default_rng(2)
    ugly = ["idiot", "moron", "worthless", "pathetic", "stupid"]
    rows, labels = [], []
    for i in range(800):
        w = ["".join(rng.choice(["the", "re", "an", "on", "ing", "st", "er"], 3)) for _ in range(40)]
        if i % 8 == 0:
            for k in range(3):
                w[int(rng.integers(0, 40))] = ugly[int(rng.integers(0, 5))]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 8 == 0)))
    hidden = {900: "then 1d10t wor7hle55 p4thet1c ing", 901: "an m o r o n and st*pid s.t.u.p.i.d", 902: "ther stuuupid mooooron", 903: "then there is nothing 123 4.5 a@b.c here", 904: None, 905: ""}
    docs = make_docs(rows + list(hidden.items()))
    model = toxicity.fit(docs, _labels(spark, labels))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in labels]) > 0.97
    assert [got[i] >= 0.3 for i in sorted(hidden)] == [True, True, True, False, False, False]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in got.items() if s < 0.3}


def _reader(extra=""):
    ugly = ["idiot", "moron", "worthless", "pathetic", "stupid"]
    rng = np.random.default_rng(5)
    prose = "you are such a man and an old friend today so go away now or stay with me in a house that is not far the moon was on".split()
    text = " ".join(str(rng.choice(ugly if k % 9 == 0 else prose)) for k in range(6000)) + extra
    counts = np.zeros(toxicity.SIZE**3)
    for b in toxicity._trigrams(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return toxicity.Reader(toxicity.LanguageModel.of(counts))


def test_tokens_of_any_length_and_few_letters():
    reader = _reader()
    assert "stupid" in reader.token("st" + "u" * 50 + "pid")
    assert {"worthless", "moron", "idiot"} <= set(reader.token("you-are-such-a-w0r7hl355-m0r0n-and-1d10t-go-away-now"))
    assert "idiot" in reader.token("1d107") and "idiot" in reader.token("1d!07") and "worthless" in reader.token("w0r7h1355")
    assert {"idiot", "moron"} <= set(reader.token("go_1d107.now/m0r0n"))
    assert reader.token("m.o_r-0.n")[-1] == "moron"
    assert len(reader.token("-".join(["w0r7h1355"] * 20_000))) > 0


def test_spaced_runs_keep_word_ends():
    reader = _reader()
    assert "moron" in reader.words("you are a m o r o n today")
    assert "worthless" in reader.words("such a w-o-r-t-h-l-e-s-s man")
    assert "idiot" in reader.words("y o u a r e a n i d i o t ok")
    assert {"stupid", "moron"} <= reader.words("a s.t.u.p.i.d m-o-r-o-n")
    assert {"worthless", "idiot"} <= reader.words("y o u a r e s u c h a w 0 r 7 h l 3 5 5 m a n a n d a n 1 d 1 0 t n o w s o g o a w a y")


def test_digest_columns(spark, sf_dir):
    r = queries.QUERIES["op6_secrets"](spark, sf_dir).filter("spans = ''").first()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_normal_equations_against_dense_solve(spark, make_docs):
    """Partition-summed normal equations give what one dense solve over all rows gives."""
    from pyspark.sql import functions as F

    from complyspark.llm.labelled import labelled, sample

    rng = np.random.default_rng(2)
    texts = [" ".join("w" * int(k) for k in rng.integers(1, 9, rng.integers(1, 60))) + "!" * int(rng.integers(0, 9)) for _ in range(300)]
    docs = make_docs(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(t.count("!") > 4)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(docs, labels, features=40)
    rows = labelled(docs, sample(labels, "quality", quality.FOLDS, quality.HELD)).withColumn("cal", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).collect()
    x = np.array([quality.statistics(r.text) for r in rows])
    y = np.array([r.y for r in rows], float)
    cal = np.array([r.cal for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.std, np.maximum(x.std(0), 1e-6))
    z = quality.lift(x[~cal], model.mean, model.std, model.w, model.b)
    assert z.shape[1] == 41
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(41), z.T @ y[~cal])
    assert np.allclose(model.coef, want, rtol=1e-6, atol=1e-8)
    knots = isotonic(quality.lift(x[cal], model.mean, model.std, model.w, model.b) @ want, y[cal])
    assert np.allclose(model.knots[0], knots[0], atol=1e-6) and np.allclose(model.knots[1], knots[1])
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert np.allclose([got[i] for i in range(300)], model.score(np.array([quality.statistics(t) for t in texts])))


def test_kernel_approximation():
    """Products of Fourier features approach the Gaussian kernel."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12, 20))
    w, b = rng.standard_normal((20, 60_000)) / 4, rng.uniform(0, 2 * np.pi, 60_000)
    z = quality.lift(x, np.zeros(20), np.ones(20), w, b)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 16))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_viterbi_against_all_readings():
    """The decoder's reading is the best of all readings of a lattice."""
    from itertools import product

    rng = np.random.default_rng(4)
    lm = toxicity.LanguageModel.of(rng.integers(0, 50, toxicity.SIZE**3).astype(float))

    def cost(letters, p):
        a = b = 0
        for ch in letters:
            z = toxicity.CODE.get(ch, 1)
            p += float(lm.table[a, b, z])
            a, b = b, z
        return p, (a, b)

    for token in ("1d10t", "$h1", "5tuuupid", "a-b", "4$$h0l3", "@$$", "w0r7h", "000", "x*y", "!"):
        places = toxicity.lattice(token)
        best = {}
        for path in product(*places):
            letters = "".join(x for x, _ in path)
            s, state = cost(letters, sum(p for _, p in path))
            key = (state, len(letters))
            if key not in best or s > best[key][0]:
                best[key] = (s, letters)
        # of each last pair of letters the likeliest reading, then the best mean
        by_state = {}
        for (state, n), (s, letters) in best.items():
            if state not in by_state or s > by_state[state][0]:
                by_state[state] = (s, n, letters)
        want = max((s + float(lm.table[a, b, 0])) / (n + 1) for (a, b), (s, n, _) in by_state.items())
        got = toxicity.decoded(places, lm)
        s, (a, b) = cost(got, 0.0)
        ways = [sum(p for _, p in path) for path in product(*places) if "".join(x for x, _ in path) == got]
        assert abs((s + max(ways) + float(lm.table[a, b, 0])) / (len(got) + 1) - want) < 1e-4, token


def test_spaced_words_of_a_sentence():
    lm = toxicity.LanguageModel.of(np.zeros(toxicity.SIZE**3))
    assert "moron" in " ".join(sorted(toxicity.Reader(lm).words("you are a m o r o n today")))


def test_scores_of_odd_tables(spark, make_docs):
    """Empty tables, no labels, null and repeated ids, texts without words."""
    odd = make_docs([(None, None), (1, None), (1, ""), (2, " \t"), (2, "x" * 5000), (2, "x" * 5000)])
    none = odd.limit(0)
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        for own in (labels, labels.limit(0)):
            q = quality.scored(docs, quality.fit(docs, own)).collect()
            t = toxicity.scored(docs, toxicity.fit(docs, own)).collect()
            assert len(q) == len(t) == docs.count()
            assert all(0 <= r.score <= 1 for r in [*q, *t])
    model = toxicity.fit(odd, labels)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert secrets.scan(none).count() == 0
