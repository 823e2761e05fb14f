"""Shards, tokenizer alignment and the Merkle manifest against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from complyspark.llm import alignment, merkle, sharding
from complyspark.llm.common import NULL_ID
from complyspark.llm.order import ranked
from complyspark.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def written(spark, tmp_path):
    def write(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def odd_docs(spark, messy, repeat=1):
    sources = ["b", None, "a", "ü", "", "Z"]
    rows = [(i, t, "en" if k % 3 else None, sources[k % 6], len(t) if t is not None and k % 4 else None) for k, (i, t) in enumerate(messy)]
    rows += [(k, f"Row {k} Of one SOURCE", "vi", "hot", k) for k in range(100, 100 + 300 * repeat)] + [(7, None, None, None, None)] * 2 + [(None, "no id", "en", "b", 3)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS `{c}`" for c in ("leaf", "_no", "_rank", "_size", "shard", "slot", "tree", "root", "_at", "_text")])


# -- order -----------------------------------------------------------------------------------


def test_ranked(spark):
    rows = [(g, x) for g, n in ((None, 5), ("a", 1), ("b", 700)) for x in range(n)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = {(r.g, r.x): (r._no, r._rank, r._size) for r in ranked(df, "g", "x").collect()}
    assert got == {(g, x): ({None: 0, "a": 1, "b": 2}[g], x, {None: 5, "a": 1, "b": 700}[g]) for g, x in rows}
    assert ranked(df.limit(0), "g", "x").count() == 0


# -- sharding ----------------------------------------------------------------------------------


def interleaved(rows, seed_ties):
    """Rows (source, shuffle key, item) of all sources in the order of their fractions."""
    by = defaultdict(list)
    for source, key, item in rows:
        by[source].append((key, item))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    line = []
    for no, s in enumerate(order):
        own = sorted(by[s], key=lambda x: x[0])
        line += [((2 * r + 1) / (2 * len(own)), seed_ties[no], no, r, item) for r, (_, item) in enumerate(own)]
    return [x[-1] for x in sorted(line)]


@pytest.mark.parametrize("together", [True, False])
def test_shards_by_rows(spark, messy, together):
    docs = odd_docs(spark, messy)
    seed = sharding.SEED
    keys = docs.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("t"), F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(NULL_ID))).alias("o")
    ).collect()
    ties = [r.t for r in spark.range(20).select(F.xxhash64(F.lit(seed), "id").alias("t")).collect()]
    rows = [(r.source, (r.t if together else 0, r.o, r.id), (r.id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode()))) for r in keys]
    line = interleaved(rows, ties)
    n, shards = len(line), 16
    want, slots = [], Counter()
    for at, item in enumerate(line):
        shard = at * shards // n
        want.append((*item, shard, slots[shard]))
        slots[shard] += 1
    got = [(r._id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs, together=together).collect()]
    assert sorted(got) == sorted(want)
    assert max(slots.values()) - min(slots.values()) <= 1


def test_shards_match_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.assign(docs, shards=4).toPandas()
    share = got.groupby("source").size() / 4
    each = got.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (abs(each - share) <= 1.0).all().all()
    again = sharding.assign(docs.repartition(5), shards=4).toPandas()
    key = ["_id", "shard", "slot"]
    assert got[key].sort_values("_id").values.tolist() == again[key].sort_values("_id").values.tolist()


def test_shards_by_bytes(spark, messy):
    docs = odd_docs(spark, messy[:10] + messy[12:], 2)
    got = sharding.assign(docs, shards=5, law="bytes").toPandas()
    assert len(got) == docs.count()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    with pytest.raises(ValueError):
        sharding.assign(docs, law="key")


def test_equal_texts_stay_together(spark):
    rows = [(k, f"copy {k // 10}", "en", "a", 1) for k in range(400)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), shards=4).toPandas()
    apart = got.groupby("text_crc32")["shard"].nunique()
    assert (apart > 1).sum() <= 3  # a group a cut


def test_written_shards(spark, tmp_path, messy):
    docs = odd_docs(spark, messy)
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.drop("shard").collect()))
    assert back.select("shard").distinct().count() == 3
    rows = sharding.sharded(docs, shards=3)
    assert rows.select("row.shard").distinct().collect()[0][0] == "x"
    assert rows.count() == docs.count()


def test_op11(spark, written, messy):
    where = written(odd_docs(spark, messy))
    got = QUERIES["op11_sharding"](spark, where)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sum(r.doc_id is None for r in rows) == 2
    assert sharding.assign(odd_docs(spark, messy).limit(0)).count() == 0


# -- alignment ---------------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b \n c", "a\n\n  b\t \tc", "x　 y", "x　  y  z", "x▁y", "z ▁", "日本語 テキスト。 ñandú", "<|endoftext|> <s> </s> <unk> it's", "\x00 \x1c  q", "é é ﬁ ｱ", "🙂 👩‍👩‍👧 ok",
    "line one\nline two\r\n\r\n  line three  ", "w" * 700 + " " + "7" * 300, "1234567 ,;:!? ...", "The the THE", "a.b.c  ", "\n \n \n a", "\ta\t b",
]


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, links, groups' text) from tokens of the whole text, by comparing ranges."""
    a_tok, b_tok = (cls(p) for cls, p in zip((alignment.ByteLevel, alignment.Pieces), alignment.default_tokenizers(), strict=True))
    out = []
    for t in texts:
        want = b" " + (t or "").encode()
        a = a_tok.tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = b_tok.tok.encode(t or "")
        joined = [b"".join(tok.bytes[i] for i in ids) for tok, ids in ((a_tok, a), (b_tok, b))]
        if not t or joined != [want, want]:
            out.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(tok.bytes[i]) for i in ids]).tolist() for tok, ids in ((a_tok, a), (b_tok, b))]
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        shared = sorted(set(ends[0]) & set(ends[1]))
        own = [defaultdict(list), defaultdict(list)]
        for side, ids, en in zip(own, (a, b), ends, strict=True):
            g = 0
            for i, e in zip(ids, en, strict=True):
                while shared[g] < e:
                    g += 1
                side[g].append(str(i))
        groups = [",".join(own[0][g]) + "|" + ",".join(own[1][g]) for g in range(len(shared))]
        out.append((len(a), len(b), len(shared), links, ";".join(groups)))
    return out


def expected(texts):
    rows = brute_alignment(texts)
    count = Counter(p for r in rows for p in r[3])
    top = defaultdict(int)
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    return [(r[0], r[1], r[2], len(r[3]), sum(count[p] == top[p[1]] for p in r[3]), sum(count[p] for p in r[3]), sha256(r[4].encode()).hexdigest() if r[0] else "") for r in rows]


def test_op12(spark, written, sf_dir, messy):
    texts = ODD_TEXTS + [t for _, t in messy if t is None or len(t) < 20_000] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [" ".join(words(9, 30_000)), "one", "one"]
    where = written(spark.createDataFrame([(k if k % 50 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, pairs long").repartition(3))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = QUERIES["op12_alignment"](spark, where)
    assert got.columns == ["doc_id", *names]
    want = [(k if k % 50 else -1, *x) for k, x in enumerate(expected(texts))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *[r[c] for c in names]) for r in got.collect()) == sorted(want)
    empty = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    assert alignment.align(empty, *alignment.default_tokenizers()).count() == 0


def test_words_are_aligned_as_whole_texts():
    """Random texts of characters that tokenizers treat apart: words' tokens are the whole text's."""
    both = alignment.Aligner(*alignment.default_tokenizers())
    rng = np.random.default_rng(3)
    alphabet = list("ab'sre Z9.,-\n\t\r") + [" "] * 6 + ["é", "日", "　", " ", " ", "ｱ", "\x1c", "\x85", "ﬁ", "🙂", "İ"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]
    t = both.chunk(texts)
    want = brute_alignment(texts)
    assert both.digests(t, len(texts)) == [sha256(w[4].encode()).hexdigest() if w[0] else "" for w in want]


def test_groups_and_products():
    both = alignment.Aligner(*alignment.default_tokenizers())
    got = both.groups(["hello wörld", "x▁", "日本"])
    want = [g for w in brute_alignment(["hello wörld", "x▁", "日本"]) for g in (w[4].split(";") if w[4] else [])]
    assert [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in zip(got["a"], got["b"], strict=True)] == want
    assert set(got["text"]) == {0, 2}
    a, b = alignment.products(np.array([2, 5, 6, 9]), np.array([1, 2, 6, 7, 8, 9]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3), (3, 4), (3, 5)]
    assert both.groups([]) == {"text": [], "a": [], "b": []}


# -- Merkle manifest --------------------------------------------------------------------------------


def H(*x):
    return sha256("".join(x).encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its runs from the bottom up."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 16], i % 16))
        level, at = [H(*r) for r in runs], [i // 16 for i in at]
    return level[0], paths


def brute_manifest(rows):
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = defaultdict(list)
    for i, t, lang, source, n in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaf, now = (H(*map(enc, (i, source, lang, n, x))) for x in (t, low(t) if changed else t))
        by[source].append((i is not None, i or 0, leaf, now))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by[s])]) for s in order]
    root, over = brute_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), up in zip(order, trees, over, strict=True):
        for (known, i, leaf, now), path in zip(sorted(by[s]), paths, strict=True):
            d = now
            for run, at in path + up:
                d = H(*run[:at], d, *run[at + 1 :])
            out.append((i if known else None, leaf, subroot, root, H(*[x for run, at in path + up for k, x in enumerate(run) if k != at]), d, d == root))
    return out


@pytest.mark.parametrize(("n", "height", "span"), [(1, 0, 1), (1, 1, 1), (2, 1, 1), (16, 1, 1), (17, 2, 1), (300, 3, 1), (1000, 3, 2), (4096, 3, 1), (4095, 3, 3), (1, 3, 1)])
def test_traversal(n, height, span):
    leaves = [H(str(k)) for k in range(n)]
    want = [[] for _ in leaves]
    level, at = leaves, list(range(n))
    for _ in range(height):
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            want[k].append((runs[i // 16], i % 16))
        level, at = [H(*r) for r in runs], [i // 16 for i in at]
    assert list(merkle.traverse(leaves, height, span)) == want


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("repeat", [1, 15])
def test_op13(spark, written, messy, repeat):
    docs = odd_docs(spark, messy, repeat)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op13_merkle"](spark, written(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_manifest(rows)))
    assert got.filter("not verified").count() > 0


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], SCHEMA)
    r = merkle.manifest(one, with_proof=True).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == []
    none = merkle.manifest(one.limit(0), with_proof=True)
    assert none.count() == 0 and none.columns == merkle.manifest(one, with_proof=True).columns


def test_proofs_lead_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.manifest(docs, with_proof=True).collect()
    assert len({r.root for r in got}) == 1 and all(r.folded_root == r.root and H(*r.proof) == r.proof_sha256 for r in got)


def test_op13_sql(spark, written, messy):
    import duckdb

    docs = odd_docs(spark, messy)
    where = written(docs)
    c = duckdb.connect()
    c.sql(f"create view documents as from '{where}/documents.parquet/*.parquet'")
    r = c.sql(SQL["op13_merkle"])
    order = QUERIES["op13_merkle"](spark, where)
    assert sorted(map(key, r.select(*order.columns).fetchall())) == sorted(map(key, order.collect()))
