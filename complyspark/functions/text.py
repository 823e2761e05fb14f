"""String functions as Spark Columns: folding, cleaning, anchors, shapes, ids.

Everything here stays inside whole-stage code generation; the folding table is
built from Unicode decomposition, not written out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and the letters they decompose to."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for lo, hi in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for c in map(chr, range(lo, hi + 1)):
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and c not in src and all(unicodedata.category(m) == "Mn" for m in marks):
                src.append(c)
                dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()
MARKS = "".join(chr(c) for c in range(0x300, 0x370))
EDGE = ",;:.–—•·- \t\"'“”‘’"  # fixed value: punctuation that clings to both ends of a read value
WORD_SEP = r"[^0-9A-Za-z]+"


def fold_diacritics(s: Column) -> Column:
    """Letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(s, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def fold_aligned(s: Column) -> Column:
    """As fold_diacritics but one character for one: offsets hold in the original."""
    return F.translate(s, FOLD_FROM + MARKS, FOLD_TO + " " * len(MARKS))


def accent_fold(s: Column) -> Column:
    """Folded, lower case, letters and digits only."""
    return F.lower(F.regexp_replace(fold_diacritics(s), "[^0-9A-Za-z]", ""))


def normalize_text(s: Column) -> Column:
    """One kind of line break, single blanks, at most one empty line in a row."""
    t = F.regexp_replace(s, "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def take_short_quote(s: Column, words: int = 25) -> Column:
    """The first `words` words."""
    return F.array_join(F.slice(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+"), 1, words), " ")


def cut_reference_clause(v: Column, stops: str, head_min: int = 12) -> Column:
    """The part before a reference clause (pattern on folded text); '' where too little
    is left; unchanged where the clause opens the value or there is none."""
    at = F.regexp_instr(F.lower(fold_aligned(v)), F.lit(stops))
    head = F.btrim(F.substring(v, F.lit(1), at - 1), F.lit(" ,;:-."))
    return F.when(at <= 1, v).when(F.length(head) >= head_min, head).otherwise(F.lit(""))


# Openings of a form's instructions to whoever fills it in (folded, lower case).
TEMPLATE_HINT = (
    r"^dien\b|^ghi\b(?!\s*chu)|^liet\s*ke\b|^neu\s*ro\b|^ke\s*khai\b|^neu\s*co\s*thi\b|^chon\s*loai\b"
    r"|^(theo\s*)?thuc\s*te(\s*dang\s*ky)?$|^\(?neu\s*co\)?$"
)
# Fixed value: a clause that only refers to the law in general (folded, lower case).
BOILERPLATE = r"^(thuc hien\s+|ap dung\s+|tuan thu\s+)?theo\s+(dung\s+|cac\s+|nhung\s+)*(quy dinh|quy che|luat|phap luat|bo luat|chinh sach|thong le)\b[^.;]{0,80}$"


def is_template_hint(s: Column) -> Column:
    return F.rlike(F.btrim(F.lower(fold_diacritics(F.coalesce(s, F.lit(""))))), F.lit(TEMPLATE_HINT))


def is_boilerplate_clause(s: Column) -> Column:
    f = F.btrim(F.lower(fold_diacritics(F.coalesce(s, F.lit("")))), F.lit(EDGE))
    return (F.length(f).between(1, 120)) & F.rlike(f, F.lit(BOILERPLATE))


def clean_value(v: Column, stops: str | None = None) -> Column:
    """A read value without clinging punctuation and doubled blanks; null where nothing
    with a letter or digit is left, or where it is a form's own hint."""
    s = F.regexp_replace(F.btrim(v, F.lit(EDGE)), r"\s+", " ")
    if stops:
        s = F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), s).otherwise(cut_reference_clause(s, stops))
    return F.when(F.rlike(s, F.lit(r"[\p{L}0-9]")) & ~is_template_hint(s), s)


def condense_clause(v: Column, keywords: list[str] | Column, max_len: int | Column) -> Column:
    """A long clause by whole sentences, those with a keyword (folded, lower case) first of all;
    a single long sentence is cut at a word."""
    folded = keywords if isinstance(keywords, Column) else F.array(*[F.lit(k.lower()) for k in keywords if k]).cast("array<string>")
    own = F.btrim(v)
    parts = F.filter(F.split(own, r"(?<=[.;!?])\s+"), lambda s: s != "")
    hits = F.filter(parts, lambda s: F.exists(folded, lambda k: F.contains(F.lower(fold_diacritics(s)), k)))
    use = F.when(F.size(hits) > 0, hits).otherwise(parts)
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["t"] == "", s).otherwise(F.concat_ws(" ", acc["t"], s))
        full = acc["full"] | ((acc["t"] != "") & (F.length(longer) > max_len))
        return F.struct(F.when(full, acc["t"]).otherwise(longer).alias("t"), full.alias("full"))

    text = F.aggregate(use, start, step, lambda a: a["t"])
    cut = F.regexp_replace(F.substring(text, F.lit(1), F.lit(max_len) if isinstance(max_len, int) else max_len), r" [^ ]*$", "")
    short = F.btrim(F.when(F.length(text) > max_len, cut).otherwise(text), F.lit(EDGE))
    return F.when(F.length(own) <= max_len, own).otherwise(short)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# Fixed value: Unicode blocks of scripts that are not Latin.
FOREIGN = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{0E00}-\x{0E7F}\x{0600}-\x{06FF}]"


def strip_foreign_chars(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(s, FOREIGN, " "), r"\s{2,}", " "))


def is_foreign_script_line(s: Column) -> Column:
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    foreign = letters - F.length(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}]", ""), FOREIGN, ""))
    return foreign * 2 > letters


def strip_chunk_ids(s: Column) -> Column:
    """Prose without internal chunk ids."""
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"(?i)\s*\(([^()]*::[^()]*)\)|\s*\S+::\d+::[0-9a-f]{4,}", ""), r"\s{2,}", " "))


def tokens(s: Column, least: int) -> Column:
    """Distinct folded alphanumeric tokens of at least `least` characters."""
    return F.filter(F.array_distinct(F.split(F.lower(fold_diacritics(F.coalesce(s, F.lit("")))), "[^a-z0-9]+")), lambda t: F.length(t) >= least)


def text_agreement(a: Column, b: Column) -> Column:
    """F1 of the token sets of two texts (null where either has none)."""
    x, y = tokens(a, 3), tokens(b, 3)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.lit(2.0) * both / (F.size(x) + F.size(y)))


def word_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein over words: each distinct word of the pair is one private-use character."""
    wa, wb = F.filter(F.split(a, r"\s+"), lambda w: w != ""), F.filter(F.split(b, r"\s+"), lambda w: w != "")
    alphabet = F.array_distinct(F.concat(wa, wb))
    # private-use code points from U+E000 on: 6400 words of a pair
    symbol = lambda w: F.decode(F.unhex(F.hex(F.array_position(alphabet, w) + 0xE000)), "UTF-16BE")
    joined = lambda ws: F.array_join(F.transform(ws, symbol), "")
    return F.when(F.size(alphabet) < 6400, F.levenshtein(joined(wa), joined(wb)))


def skeleton(w: Column) -> Column:
    return F.translate(w, "aeiouy", "")


def match_case(src: Column, repl: Column) -> Column:
    """`repl` in the letter case of `src`."""
    first = F.concat(F.upper(F.substring(repl, 1, 1)), F.substring(repl, F.lit(2), F.length(repl)))
    upper = (src == F.upper(src)) & (src != F.lower(src)) & (F.length(src) > 1)
    return F.when(upper, F.upper(repl)).when(F.substring(src, 1, 1) != F.lower(F.substring(src, 1, 1)), first).otherwise(repl)


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of `short` occur in `long` in order."""
    chars = F.filter(F.split(short, ""), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.struct(long.alias("s"), F.lit(True).alias("ok")),
        lambda acc, c: F.struct(
            F.when(F.instr(acc["s"], c) > 0, F.substring(acc["s"], F.instr(acc["s"], c) + 1, F.length(acc["s"]))).otherwise(acc["s"]).alias("s"),
            (acc["ok"] & (F.instr(acc["s"], c) > 0)).alias("ok"),
        ),
    )
    return rest["ok"]


def junk_ratio(text: Column) -> Column:
    """Share of Latin words with punctuation between letters or a capital after a small
    letter; null under 20 words; 3 digits."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 2) & (F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 2))
    bad = F.filter(words, lambda w: F.rlike(F.btrim(w, F.lit(".,;:()[]{}\"'-–—/*|")), F.lit(r"\p{L}[^\p{L}\p{N}]\p{L}|\p{Ll}\p{Lu}")))
    return F.when(F.size(words) >= 20, F.round(F.size(bad) / F.size(words), 3))


def label_pattern(label: str) -> str:
    """A label as a pattern that tolerates blanks and punctuation between its words."""
    special = set(".^$*+?{}[]\\|()")
    words = ["".join("\\" + c if c in special else c for c in w) for w in label.split()]
    return r"[\s,:.\-]*".join(words)


def clean_markdown(line: Column) -> Column:
    """A line without fences, rules and markup; a table row of two cells as `label: value`."""
    t = F.regexp_replace(line, r"^\s*(```.*|[-*_]{3,}|\|?\s*:?-{2,}.*)\s*$", "")
    two = F.regexp_extract(t, r"^\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|\s*$", 1)
    other = F.regexp_extract(t, r"^\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|\s*$", 2)
    plain = F.btrim(F.regexp_replace(F.regexp_replace(t, r"^\s*#{1,6}\s*", ""), r"\*\*|__|`", ""))
    return F.when(two != "", F.concat(two, F.lit(": "), other)).otherwise(plain)


def strip_numbering(line: Column) -> Column:
    """A folded, lower-case line without its leading article or item number."""
    f = F.lower(F.btrim(fold_diacritics(line)))
    return F.regexp_replace(f, r"^(?:dieu\s*\d+[.):\-]?|[ivxlcdm]+[.)]|\d+[.):\-]?)\s*", "")


def starts_with_anchor(line: Column, anchors: list[str]) -> Column:
    head = F.regexp_replace(strip_numbering(line), "[^0-9a-z]", "")
    return _any([F.startswith(head, F.lit(a)) for a in anchors])


def has_anchor(line: Column, anchors: list[str]) -> Column:
    folded = accent_fold(line)
    return _any([F.contains(folded, F.lit(a)) for a in anchors])


def slug(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(fold_diacritics(s)), "[^a-z0-9]+", "-"), F.lit("-"))


def title_of(name: Column, text: Column) -> Column:
    """The first heading of the first 40 lines, else the name."""
    heads = F.filter(F.slice(F.split(text, "\n"), 1, 40), lambda s: F.rlike(s, F.lit(r"^#+\s+\S")))
    return F.coalesce(F.substring(F.btrim(F.regexp_replace(F.get(heads, 0), r"^#+\s+", ""), F.lit(" \t\r")), 1, 160), name)


def infer_doc_type(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The type of the first keyword that a folded file name holds."""
    f = accent_fold(name)
    out = F.lit(default)
    for keyword, kind in reversed(rules):
        out = F.when(F.contains(f, F.lit(keyword)), kind).otherwise(out)
    return out


def mask(key: Column, shown: int = 4) -> Column:
    return F.when(F.length(key) > 0, F.concat(F.lit("••••"), F.right(key, F.lit(shown)))).otherwise("")


def split_reason(s: Column) -> Column:
    """Sentences and bullets of a reason; a break needs a capital behind it."""
    return F.filter(F.transform(F.split(s, r"(?<=[.;!?])\s+(?=[\p{Lu}-])|\n+"), lambda x: F.btrim(x)), lambda x: x != "")


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.concat_ws("::", source, index.cast("string"), F.substring(F.sha1(text), 1, 12))


def content_hash(text: Column) -> Column:
    """SHA-256 with one kind of line break."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


# How parts, chapters, sections and articles begin, with and without marks, and the level of each.
HEADINGS = (
    (2, r"(phần|phan|part)\s+((thứ|thu)\s+)?[0-9a-zà-ỹđ]+"),
    (2, r"(chương|chuong|chapter)\s+[ivxlc0-9]+(?![0-9a-zà-ỹđ])"),
    (3, r"(mục|muc|section)\s+[0-9]+(?![0-9a-zà-ỹđ])"),
    (3, r"(điều|dieu|article)\s+[0-9]+[a-zđ]?\s*[.:]"),
)


def heading_level(line: Column) -> Column:
    """2 for parts and chapters, 3 for sections and articles (these before a stop or colon only), else null."""
    low = F.lower(F.btrim(line, F.lit(" \t\r")))
    out = F.lit(None).cast("int")
    for level, pattern in reversed(HEADINGS):
        out = F.when(F.rlike(low, F.lit(f"^{pattern}")), level).otherwise(out)
    return out


def golden_normalize(v: Column) -> Column:
    """A value for comparison with a golden one: folded, lower case, single blanks, no edge punctuation."""
    return F.btrim(F.regexp_replace(F.lower(fold_diacritics(F.coalesce(v, F.lit("")))), r"\s+", " "), F.lit(EDGE))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    digit = lambda d, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d + 1).cast("int"))
    part = lambda k: F.floor(n / k) % 10
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(part(100), "C", "D", "M"), digit(part(10), "X", "L", "C"), digit(part(1), "I", "V", "X"))


def value_text(value: Column, amount: Column, currency: Column, period: Column, raw: Column) -> Column:
    """Canonical text of a value for comparison: of money the amount (whole ones without decimals) or else
    the raw text, then currency and period; single blanks."""
    whole = F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(amount.cast("string"))
    money = F.concat_ws(" ", F.coalesce(whole, raw), F.nullif(currency, F.lit("")), F.nullif(period, F.lit("")))
    given = amount.isNotNull() | raw.isNotNull()
    number = F.regexp_replace(F.coalesce(value, F.lit("")), r"^(-?\d+)\.0+$", "$1")
    return F.btrim(F.regexp_replace(F.when(given, money).otherwise(number), r"\s+", " "))


def unwrap_object(value: Column) -> Column:
    """Text that a model wrapped into an object: its `raw`, null where there is none; other values stay."""
    raw = F.get_json_object(value, "$.raw")
    return F.when(F.rlike(value, F.lit(r"^\s*\{")), F.when(F.btrim(raw) != "", raw)).otherwise(value)
