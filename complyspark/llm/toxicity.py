"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. A suspicious token
(leetspeak with or without letters, a letter repeated three times or more, letters
spaced out) is a lattice: each of its characters may be itself, a letter it
stands for, or noise, and a separator of a spaced run noise or a word's end. Viterbi finds the reading that the language model likes
best, and the restored text is scored by a logistic regression on its words and
their beginnings, fitted on labelled documents read the same way."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, lean_batches, release
from .labelled import fold, labelled, sample

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
TOP = 1500
"""Features kept of all words and beginnings, those with the greatest G2 against the label."""
LEAST = 4
"""Toxic training documents that a feature must occur in."""
CACHE = 60_000

# Letters that leetspeak characters stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou",
}

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
SIZE = len(LETTERS) + 2
"""Symbols of the language model: 0 is a word's edge, 1 any other letter."""
CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_LUT = np.zeros(0x250, np.int64)
for _c in range(0x250):
    if chr(_c).isalpha():
        _LUT[_c] = CODE.get(chr(_c).lower(), 1)


# -- the language model ---------------------------------------------------------------------------


def _runs(texts: list[str | None], size: int = 1 << 20) -> Iterator[str]:
    """Texts joined by blanks, in parts of about `size` characters that overlap by two."""
    held: list[str] = [""]
    n = 0
    for k, x in enumerate(texts):
        held.append(x or "")
        n += len(held[-1])
        if n >= size or k == len(texts) - 1:
            whole = " ".join([*held, ""])
            held, n = [""], 0
            for a in range(0, len(whole), size):
                yield whole[max(0, a - 2) : a + size]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        total = np.zeros(SIZE**3, np.int64)
        for part in _runs(t.column(0).to_pylist()):
            raw = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            code = np.where(raw < 0x250, _LUT[np.minimum(raw, 0x24F)], 1)
            gram = (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:]
            total += np.bincount(gram, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


@dataclass
class LanguageModel:
    """Log probabilities of a character after two others, smoothed with shorter contexts."""

    table: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> LanguageModel:
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
        return LanguageModel(np.log(p3).astype(np.float32))


def language_model(docs: DataFrame) -> LanguageModel:
    """Counted over every whole text; what reaches the driver has one row a trigram of a fixed alphabet."""
    got = docs.select("text").mapInArrow(lean(_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel.of(counts)


# -- the channel -----------------------------------------------------------------------------------

AS_IS, STANDS_FOR, NOISE, REPEAT = 0.0, -0.7, -1.0, -0.3
LOST = -9.0
"""A character that stands for a letter is noise after all."""
_RUN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W_](?:[ .\-_*]{1,2}[^\W_]){3,}(?![^\W\d_])")
_NEXT = re.compile(r"([ .\-_*]{1,2})([^\W_])")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place the readings (letters, log probability); a run of three or more
    equal characters is one place, read once or twice."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        i = j
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, AS_IS))
        options += [(x, STANDS_FOR) for x in LEET.get(c, "")]
        noise = LOST if c.isalnum() or c in "$@" else NOISE
        if n >= 3:
            out.append([(x * k, p + (REPEAT if k == 2 else 0.0)) for x, p in options for k in (1, 2)] + ([] if c.isalpha() else [("", noise)]))
            continue
        if not c.isalpha():
            options.append(("", noise))
        out += [options] * n
    return out


def decoded(places: list[list[tuple[str, float]]], lm: LanguageModel, ends: list[float | None] | None = None) -> str:
    """The best reading of a lattice: one word, or words with blanks between where `ends` has the
    log probability that a word ends before a place. Readings are chains of their parts, so
    a lattice of any length takes time in proportion."""
    table = lm.table
    best: dict[tuple[int, int], tuple[float, int, tuple | None]] = {(0, 0): (0.0, 0, None)}
    for at, options in enumerate(places):
        if ends and (p := ends[at]) is not None:
            for (a, b), (score, size, chain) in list(best.items()):
                s = score + p + float(table[a, b, 0])
                if b and ((old := best.get((b, 0))) is None or s > old[0]):
                    best[b, 0] = (s, size + 1, (chain, " "))
        now: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}
        for (a, b), (score, size, chain) in best.items():
            for letters, p in options:
                s, x, y = score + p, a, b
                for ch in letters:
                    z = CODE.get(ch, 1)
                    s += float(table[x, y, z])
                    x, y = y, z
                if (old := now.get((x, y))) is None or s > old[0]:
                    now[x, y] = (s, size + len(letters), (chain, letters) if letters else chain)
        best = now
    if not best:
        return ""
    # the mean over a word's characters: readings of unlike length compare fairly
    chain = max(((s + float(table[a, b, 0])) / (n + 1), k, c) for k, ((a, b), (s, n, c)) in enumerate(best.items()))[2]
    parts = []
    while chain is not None:
        chain, letters = chain
        parts.append(letters)
    return "".join(reversed(parts))


def viterbi(token: str, lm: LanguageModel) -> str:
    """The best reading of a lower-case token as one word."""
    return decoded(lattice(token), lm)


ENDS = (-4.0, -2.0, 0.0, 2.0, 4.0)
"""Log probabilities, against noise, that a separator in a spaced run ends a word: a run is read under each."""
UNLIKE = 6.0
"""More for a separator that is unlike the run's usual one."""


def spaced(run: str, lm: LanguageModel) -> set[str]:
    """Words of characters with separators between, each of which is noise or ends a word."""
    chars, gaps = [run[0]], [""]
    for m in _NEXT.finditer(run, 1):
        gaps.append(m[1])
        chars.append(m[2])
    usual = Counter(gaps[1:]).most_common(1)[0][0]
    places, seps = [], []
    for _, part in groupby(range(len(chars)), key=lambda i: chars[i]):
        own = list(part)
        got = lattice("".join(chars[i] for i in own))
        places += got
        seps += [gaps[i] for i in own[: len(got)]]
    out = {decoded(places, lm)}
    for p in ENDS:
        out.update(decoded(places, lm, [None if not g else p + UNLIKE * (g != usual) for g in seps]).split())
    return out


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


_JOINT = re.compile(r"(?:_|[^\w@$!|+(€£¡*])+")
"""What joins words: symbols that stand for no letter."""


def suspicious(token: str) -> bool:
    """Whether a token without its outer punctuation needs decoding: a letter is repeated, or there
    are other characters than letters. What such a token reads as is left to the language model."""
    return _RUN.search(token) is not None if token.isalpha() else len(token) >= 3


@dataclass
class Reader:
    """Restored words of tokens, with a bounded cache."""

    lm: LanguageModel
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def token(self, raw: str) -> tuple[str, ...]:
        low = raw.lower()
        core = low.strip(_EDGE)
        left = low[: low.find(core)] if core else low
        if left and left[-1] in "$@!|(+" and (core or len(low) > 2):
            core = left[-1] + core
        if not core:
            return ()
        tail = low[low.rfind(core[-1]) + 1 :]
        if tail and tail[0] == "$" and suspicious(core):
            core += "$" * (len(tail) - len(tail.lstrip("$")))
        if core.isalpha() and not _RUN.search(core):
            return (core,)
        plain = tuple(p for p in re.split(r"[\W\d_]+", core) if p)
        if not suspicious(core):
            return plain
        # parts keep their digits; the whole is read too, as what joins may be noise within a word
        parts = {p for p in _JOINT.split(core) if suspicious(p)} - {core}
        return (*plain, *(viterbi(p, self.lm) for p in sorted(parts)), viterbi(core, self.lm))

    def words(self, text: str) -> set[str]:
        """All words of a text, restored."""
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        out: set[str] = set()
        for raw in set(text.split()):
            got = known.get(raw)
            if got is None:
                got = known[raw] = self.token(raw)
            out.update(got)
        for m in _SPACED.finditer(text):
            out |= spaced(m[0].lower(), self.lm)
        return out


# -- the classifier -------------------------------------------------------------------------------------


def names(words: set[str]) -> set[str]:
    """Features of a text: its words, and the beginnings of longer ones."""
    return {"=" + w for w in words} | {w[:n] for n in PREFIXES for w in words if len(w) >= n}


@dataclass
class Model:
    lm: LanguageModel
    weight: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        weight = self.weight
        found: set[str] = set()
        for w in words:
            if "=" + w in weight:
                found.add("=" + w)
            for n in PREFIXES:
                if len(w) >= n and w[:n] in weight:
                    found.add(w[:n])
        z = self.bias + sum(weight[f] for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(lm: LanguageModel):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm)
        schema = ["name", "toxic", "clean"]
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=schema)
            toxic.clear()
            clean.clear()
            return out

        for t in batches:
            for text, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(names(reader.words(text)))
                if len(toxic) + len(clean) > 100_000:
                    yield flush()
        yield flush()

    return f


def _present(lm: LanguageModel, index: dict[str, int]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm)
        for t in batches:
            rows = [[index[n] for n in names(reader.words(x)) if n in index] for x in t.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), t.column(1)], names=["at", "y"])

    return f


def regression(rows: list[list[int]], y: np.ndarray, size: int, steps: int = 800, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by gradient steps with momentum."""
    w, bias = np.zeros(size), 0.0
    if not len(y):
        return w, bias
    row = np.repeat(np.arange(len(y)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(rate / (1 - rate))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + bias
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, d[row], minlength=size) + ridge * w, d.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = FOLDS, held: int = HELD) -> Model:
    """The language model of all texts, and the classifier of a bounded sample of
    labelled rows outside the held-out fold (see labelled.py).

    Null and empty texts have no words and teach the model nothing; very long texts are read whole. Null labels and labels of a
    null id are left out; of several labels of a document the greatest holds. Features tie by name. An empty
    table, or no labels, gives a model without features, whose scores are all equal. Other columns are ignored."""
    lean_batches(docs.sparkSession)
    lm = language_model(docs)
    rows = cut(labelled(docs, sample(labels, label, mod, held)).select("text", "y"))
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    counts = cut(rows.mapInArrow(lean(_count(lm)), "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")))
    # exp(-G2 / 2) bounds the chance of a feature, so one of all features by chance has half a G2 of log(features)
    evidence = math.log(max(2, counts.count()))
    counts = counts.filter(F.col("a") >= LEAST)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    both = a + b
    g2 = part(a, both * n1 / (n1 + n0)) + part(b, both * n0 / (n1 + n0)) if n1 + n0 else F.lit(0.0)
    # only what speaks for toxicity: clean texts have no words of their own
    chosen = counts.filter(a * n0 > 2 * b * n1).filter(g2 >= evidence).orderBy(g2.desc(), "name").limit(TOP).select("name").collect()
    index = {r["name"]: i for i, r in enumerate(chosen)}
    seen = rows.mapInArrow(lean(_present(lm, index)), "at array<int>, y int").toArrow()
    w, bias = regression(seen.column("at").to_pylist(), seen.column("y").to_numpy().astype(np.float64), len(index))
    release(docs.sparkSession)
    return Model(lm, {n: float(w[i]) for n, i in index.items() if abs(w[i]) > 1e-3}, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every whole text of `docs`. Null and empty texts get the score of no words; very long ones are
    read whole; equal texts get equal scores; repeated rows and null ids give a row each; other columns are
    ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # a table over a fixed alphabet and TOP weights

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        reader = Reader(own.lm)
        for t in batches:
            scores = [own.score(reader.words(x or "")) for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(f), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are and whatever they are called, whose text scores below
    `threshold`: a row that ties with it goes. Null and empty texts stay where no words score below it, very long
    ones are read whole, repeated rows are decided alike, an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        reader = Reader(own.lm)
        for t in batches:
            keep = [own.score(reader.words(x or "")) < threshold for x in t.column(at).to_pylist()]
            yield t.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(f), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of `documents`, learnt from `labels`; odd input as in `fit` and `scored`. A null id is outside the
    held-out fold, as the checksum of no text is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
