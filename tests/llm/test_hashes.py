"""Words that a polynomial hash modulo 2 ** 64 takes for one: Thue-Morse words and their complements."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from complyspark.llm import common, near_copies, packing, tokens
from complyspark.llm.queries import QUERIES

T = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
U = T.translate(str.maketrans("ab", "ba"))
SHORT, TROHS = T[:64], U[:64]


def hashes(words, seed=0):
    data, offs = common.utf8(pa.array(words))
    return common.word_hashes(data, offs[:-1], offs[1:], seed)


def test_word_hashes():
    rng = np.random.default_rng(0)
    words = list(dict.fromkeys([T, U, SHORT, TROHS, "", "a", "b", "a" * 8, "a" * 9, "a" * 16, "a" * 256, "a" * 257, "a\0", "\0", "\0\0"] + ["".join(rng.choice(list("abc"), rng.integers(1, 30))) for _ in range(5000)]))
    for seed in (0, 1, 2):
        assert len(set(hashes(words, seed).tolist())) == len(words)
    # a word's hash is its own, whatever lies around it
    assert hashes(words)[7] == hashes([words[7]])[0] and hashes(words[::-1])[::-1].tolist() == hashes(words).tolist()
    assert not set(hashes(words, 0).tolist()) & set(hashes(words, 1).tolist())


def docs_of(spark, tmp_path, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_op1(spark, tmp_path):
    got = QUERIES["op1_fingerprints"](spark, docs_of(spark, tmp_path, [T, U])).collect()
    assert len({r.fingerprint for r in got}) == 2 and max(r.near_next for r in got) < 0.1


def test_op2(spark, tmp_path):
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join([*words[:15], x, *words[15:]]) for x in (T, U)] + [" ".join([T] * 25), " ".join([U] * 25)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op2_substring_dedup"](spark, docs_of(spark, tmp_path, texts)).collect()}
    assert got[0] == got[1] == (31, 0)
    assert got[2][1] == got[3][1] == 24  # each repeats itself alone: its first word stays


def test_op5(spark, tmp_path):
    ids = Tokenizer.from_file(packing.default_tokenizer())
    want = {k: zlib.crc32(np.array([*ids.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in enumerate([T, U])}
    got = QUERIES["op5_packing"](spark, docs_of(spark, tmp_path, [T, U])).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want
    both = tokens.word_ids(packing.default_tokenizer()).of([T.encode(), U.encode()])
    assert both[0] != both[1]


def test_near_copies(spark):
    df = spark.createDataFrame([(0, " ".join([T] * 7)), (1, " ".join([U] * 7))], "doc_id long, text string")
    assert near_copies.one_of_each(df).count() == 2


def test_places_lose_no_pair():
    """Two sets at the similarity meet at a place of both prefixes from which they can reach it."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = rng.choice(200, n, replace=False)
        b = np.concatenate([rng.permutation(a)[: n - int(rng.integers(0, n // 5 + 1))], 200 + np.arange(int(rng.integers(0, n // 5 + 1)))])
        a, b = (np.unique([int(hashlib.md5(bytes([int(x) % 256, int(x) // 256])).hexdigest()[:8], 16) for x in s]).astype(np.uint64) for s in (a, b))
        shared, total = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if near_copies.DEN * shared < near_copies.NUM * total:
            continue
        p, q = (near_copies.prefix(s, np.zeros(0, np.uint64), np.zeros(0, np.int32)).tolist() for s in (a, b))
        assert any((near_copies.DEN + near_copies.NUM) * min(len(a) - p.index(c), len(b) - q.index(c)) >= near_copies.NUM * (len(a) + len(b)) for c in p if c in q)
