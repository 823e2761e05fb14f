"""Alignment of two tokenizers over the same bytes, by elementary intervals.

The ends of both tokenizers' tokens cut the bytes into elementary intervals (the union of both arrays of ends). Each
interval lies in just one token of either side, which searchsorted finds: it is one overlap, a link. Ends that both
share close a group. All texts of a chunk are one sequence of bytes, so these are a few NumPy calls a chunk.

Tokens of whole texts are had from those of their words: a cut before a space that follows a
character that is no white space parts tokens of either kind (the byte-level vocabulary's pattern gives a
space to what follows it; no piece of the other one has a space after another character, which is looked up when it
is loaded). A worker keeps the tokens of the words it met, told apart by their text, in a table of bounded size.

Counts of id pairs are summed over the corpus in two steps: a task counts a chunk's links by pair, Spark sums these.
Each chunk then gets the counts of its own pairs back, by a join on the pair, and its rows add them up: links
themselves never travel."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, cut, doc_id, keyed, lean, utf8

ENTRIES = 400_000
"""Words that a worker's table keeps; when it is full it starts anew."""
TOKENS = 8_000_000
"""Tokens of either kind that the table keeps."""
LONG_WORD = 256
"""Longer words are encoded each time they come and not kept."""
SHIFT = 32
CHUNK_BYTES = 1 << 20

_GAPS = re.compile(r"^\s|\s\s|\s$")
_SPACE = re.compile(r"\s")
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


def words_of(text: str) -> list[str]:
    """The parts of a text, each without the space before it: joined by spaces they are the text again. Runs of white
    space stay with what follows them, those at the end with what comes before."""
    if not _GAPS.search(text):
        return text.split(" ")
    return [w[1:] for w in _CUT.split(" " + text)]


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        of = _byte_of_char()
        vocab = self.tok.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of a space and each word."""
        return [e.ids for e in self.tok.encode_batch([" " + w for w in words], add_special_tokens=False)]

    def line(self, words: list[str]) -> list[int]:
        """Ids of words without white space, a space before each."""
        return self.tok.encode(" " + " ".join(words), add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; it adds the space itself."""

    def __init__(self, path: str):
        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("a piece has a space after another character: words can't be encoded alone")
        self.bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.tok.encode(words, num_threads=1)

    def line(self, words: list[str]) -> list[int]:
        return self.tok.encode(" ".join(words))


class Side:
    """Token ids of words met so far, one after the other, and where each word's begin."""

    def __init__(self, tokens: ByteLevel | Pieces):
        self.tokens = tokens
        self.width = np.array([len(b) for b in tokens.bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _line(self, words: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words as of one line, and how many each has; None where a token goes across words or their bytes differ."""
        ids = self.tokens.line(words)
        if b"".join(map(self.tokens.bytes.__getitem__, ids)) != b" " + b" ".join(raw):
            return None
        ids = np.array(ids, np.int32)
        ends, words_end = np.cumsum(self.width[ids]), np.cumsum([len(r) + 1 for r in raw])
        at = np.searchsorted(ends, words_end)
        return (ids, np.diff(at + 1, prepend=0)) if (ends[at] == words_end).all() else None

    def add(self, words: list[str], plain: bool) -> np.ndarray:
        """Appends the tokens of new words; whether each one's bytes are a space and the word. `plain`: none has white space."""
        raw = [w.encode() for w in words]
        found = self._line(words, raw) if plain else None
        exact = np.ones(len(words), bool)
        if found is None:
            each, of = self.tokens.encode(words), self.tokens.bytes
            exact[:] = [b"".join([of[i] for i in e]) == b" " + r for e, r in zip(each, raw, strict=True)]
            found = np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int64)
        self.ids = np.concatenate([self.ids, found[0]])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(found[1])])
        return exact

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all entries in a row, and how many each has."""
        n = self.start[entries + 1] - self.start[entries]
        to = np.append(0, np.cumsum(n))
        return self.ids[np.repeat(self.start[entries] - to[:-1], n) + np.arange(to[-1])], n


class Words:
    """Both tokenizers' tokens of words."""

    def __init__(self, byte_level: str, pieces: str):
        self.sides = (Side(ByteLevel(byte_level)), Side(Pieces(pieces)))
        self.clear()

    def clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.exact = np.zeros(0, bool)
        for s in self.sides:
            s.clear()

    def _learn(self, words: list[str], plain: bool) -> None:
        for k in range(0, len(words), 4096):
            a, b = (s.add(words[k : k + 4096], plain) for s in self.sides)
            self.exact = np.concatenate([self.exact, a & b])

    def find(self, words: list[str]) -> np.ndarray:
        """Entries of words, which are learnt where they are new."""
        if len(self.exact) > ENTRIES or any(len(s.ids) > TOKENS for s in self.sides):
            self.clear()
        get = self.entry.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = dict.fromkeys(words[i] for i in missing)
            plain = [w for w in new if w and not _SPACE.search(w)]
            odd = [w for w in new if not w or _SPACE.search(w)]
            new, base = plain + odd, len(self.exact)
            self._learn(plain, True)
            self._learn(odd, False)
            own = {w: base + k for k, w in enumerate(new)}
            found[missing] = [own[words[i]] for i in missing]
            self.entry.update((w, e) for w, e in own.items() if len(w) <= LONG_WORD)
        return found


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.union1d` of two ascending arrays without repeats, by a merge, and which of its elements are in both."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two ascending runs: one merge
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return both[at], np.diff(np.append(at, len(both))) == 2


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners (token of A, token of B) of each elementary interval, and the ends that both share."""
    ends, twice = union(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends[twice]


def products(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a group, whether their bytes overlap or not: each group's product."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    n_a, n_b = np.diff(np.searchsorted(a_ends, shared, "right"), prepend=0), np.diff(np.searchsorted(b_ends, shared, "right"), prepend=0)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    size = n_a * n_b
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(n_b, size)
    return np.repeat(first_a, size) + inner // wide, np.repeat(first_b, size) + inner % wide


class _Names:
    """Decimal ids with what follows them in a group's text."""

    def __init__(self, n: int):
        self.comma = np.array([f"{i}," for i in range(n)], object)
        self.bar = np.array([f"{i}|" for i in range(n)], object)
        self.end = np.array([f"{i};" for i in range(n)], object)


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.words = Words(byte_level, pieces)
        self.names = _Names(max(len(s.width) for s in self.words.sides))

    def groups(self, texts: list[str]) -> dict[str, list]:
        """Groups of each text as lists of ids of A and of B: the alignment itself."""
        t = self.chunk(texts)
        a, b = np.split(t["a_ids"], np.searchsorted(t["a_ends"], t["shared"], "right")[:-1]), np.split(t["b_ids"], np.searchsorted(t["b_ends"], t["shared"], "right")[:-1])
        text = np.searchsorted(t["offsets"], t["shared"], "left") - 1
        return {"text": text.tolist(), "a": [x.tolist() for x in a], "b": [x.tolist() for x in b]} if len(t["shared"]) else {"text": [], "a": [], "b": []}

    def chunk(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Tokens, ends, links and groups of all texts as one sequence of bytes; texts whose bytes the tokens don't give have none."""
        split = [words_of(t) if t else [] for t in texts]
        per = np.array([len(w) for w in split], np.int64)
        entries = self.words.find([w for ws in split for w in ws])
        row = np.repeat(np.arange(len(texts)), per)
        exact = np.ones(len(texts), bool)
        exact[row[~self.words.exact[entries]]] = False
        kept = exact[row]
        entries, row = entries[kept], row[kept]
        out: dict[str, np.ndarray] = {}
        for name, side in zip("ab", self.words.sides, strict=True):
            ids, n = side.gather(entries)
            out[f"{name}_ids"], out[f"{name}_ends"], out[f"{name}_row"] = ids, np.cumsum(side.width[ids]), np.repeat(row, n)
        link_a, link_b, shared = intervals(out["a_ends"], out["b_ends"])
        out |= {"link_a": link_a, "link_b": link_b, "shared": shared, "exact": exact}
        size = np.bincount(out["a_row"], side_width(self.words.sides[0], out["a_ids"]), len(texts)).astype(np.int64)
        out["offsets"] = np.append(0, np.cumsum(size))
        return out

    def digests(self, t: dict[str, np.ndarray], n: int) -> list[str]:
        """Lowercase hex of each text's groups, written `a1,a2|b1;a3|b2`; texts without tokens: empty."""
        parts = []
        for name, last in (("a", self.names.bar), ("b", self.names.end)):
            ids, ends = t[f"{name}_ids"], t[f"{name}_ends"]
            words = self.names.comma[ids]
            closing = np.searchsorted(ends, t["shared"])
            words[closing] = last[ids[closing]]
            parts.append((words, np.searchsorted(t["shared"], ends)))
        (a, a_group), (b, b_group) = parts
        # within a group A's tokens, then B's: both sides are in order already, a stable sort keeps them so
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        line = np.concatenate([a, b])[order]
        row = np.concatenate([t["a_row"], t["b_row"]])[order]
        at = np.searchsorted(row, np.arange(n + 1)).tolist()
        line = line.tolist()
        return [sha256("".join(line[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]


def side_width(side: Side, ids: np.ndarray) -> np.ndarray:
    return side.width[ids]


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _loaded:
        _loaded[byte_level, pieces] = Aligner(byte_level, pieces)
    return _loaded[byte_level, pieces]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- Spark --------------------------------------------------------------------------------

_DOC = "_id:bigint,_k:int,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,used:array<int>,times:array<int>"
_CHUNK = f"chunk long, pairs array<bigint>, n array<bigint>, docs array<struct<{_DOC}>>"


def _linked(paths: tuple[str, str]):
    """Each chunk of texts as one row: its distinct id pairs with their links, and for each text its counts,
    which of these pairs it holds and how often."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        no = TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            ids, ks, col = batch.column("_id").to_pylist(), batch.column("_k").to_pylist(), batch.column("text")
            for i, j in chunks(utf8(col)[1], CHUNK_BYTES):
                texts = col.slice(i, j - i).to_pylist()
                t = both.chunk(texts)
                n = len(texts)
                link_row = t["a_row"][t["link_a"]]
                pair = (t["a_ids"][t["link_a"]].astype(np.int64) << SHIFT) | t["b_ids"][t["link_b"]]
                pairs, which, total = np.unique(pair, return_inverse=True, return_counts=True)
                used, times = np.unique(link_row.astype(np.int64) * max(len(pairs), 1) + which, return_counts=True)
                of, used = np.divmod(used, max(len(pairs), 1))
                cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
                group_row = t["a_row"][np.searchsorted(t["a_ends"], t["shared"])]
                counts = [np.bincount(r, minlength=n).tolist() for r in (t["a_row"], t["b_row"], group_row, link_row)]
                docs = [
                    {"_id": ids[i + k], "_k": ks[i + k], "n_a": counts[0][k], "n_b": counts[1][k], "n_groups": counts[2][k], "n_links": counts[3][k], "groups_sha256": sha, "used": used[x:y], "times": times[x:y]}
                    for k, (sha, x, y) in enumerate(zip(both.digests(t, n), cuts, cuts[1:], strict=False))
                ]
                yield pa.RecordBatch.from_pylist([{"chunk": no, "pairs": pairs.tolist(), "n": total.tolist(), "docs": docs}], schema=_ARROW)
                no += 1

    return lean(f)


_ARROW = pa.schema([
    ("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
    ("docs", pa.list_(pa.struct([("_id", pa.int64()), ("_k", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("used", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]))),
])

def pair_counts(linked: DataFrame) -> DataFrame:
    """`pair, count, best`: links of each id pair (A's id << 32 | B's id) over the corpus, and whether no A id has more links with its B id."""
    counts = cut(linked.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    top = counts.groupBy(b).agg(F.max("count").alias("top"))  # at most a row an id of B's vocabulary
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """`_id, _k, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` of every row of `docs` (`doc_id`, `text`).

    Null and empty texts, and those whose bytes either side's tokens don't give back, have no tokens; very long texts are aligned
    whole, as a chunk of their own. Repeated rows and null ids are rows of their own; ties for the best count are all best.
    Other columns are ignored, whatever they are called; an empty table gives no rows."""
    rows = keyed(docs, "doc_id", "text")
    linked = cut(rows.mapInArrow(_linked((byte_level, pieces)), _CHUNK))
    own = linked.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(linked), "pair")
    by_chunk = own.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("c"))
    known = by_chunk.select("chunk", F.col("c.count").alias("count"), F.col("c.best").alias("best"))
    # the sums are taken inside the chunk's row, so that its counts aren't copied to every text's
    summed = F.transform("docs", lambda d: F.struct(*[d[c].alias(c) for c in _KEPT], _sum(d, "best").alias("n_best"), _sum(d, "count").alias("count_sum")))
    return linked.select("chunk", "docs").join(known, "chunk", "left").select(F.inline(summed))


_KEPT = ("_id", "_k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _sum(d: Column, of: str) -> Column:
    """The chunk's figures `of` its pairs, added up over the links of the text `d`."""
    each = F.zip_with(d["used"], d["times"], lambda u, t: F.get(of, u).cast("long") * t)
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`align` of all of `documents`; odd input as there."""
    got = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
    return got.select(doc_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
