"""Pages and lines: trust of a text layer, windows of pages, repeats, anchors, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_anchor, is_foreign_script_line, junk_ratio, starts_with_anchor, strip_foreign_chars, text_agreement


def lines(docs: DataFrame) -> DataFrame:
    """`doc_id, line_no, text` of every line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def trusted(chars: Column, junk: Column, least: int = 200, most: float = 0.06) -> Column:
    """Enough characters and not too much junk (null: too little text to tell)."""
    return (chars >= least) & (junk.isNull() | (junk <= most))


def page_quality(docs: DataFrame) -> DataFrame:
    j = junk_ratio(F.col("text"))
    return docs.select("doc_id", F.length("text").alias("chars"), j.alias("junk")).withColumn("trusted", trusted(F.col("chars"), F.col("junk")))


def read_plan(pages: DataFrame) -> DataFrame:
    """Page indices of a document to read as text and to read as images."""
    by = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_index"))))
    return pages.groupBy("doc_id").agg(by(F.col("trusted")).alias("text_pages"), by(~F.col("trusted")).alias("image_pages"))


def restrict(pages: DataFrame, skip: DataFrame) -> DataFrame:
    """Pages without the skipped ones; all of a document's where that would leave none."""
    m = pages.join(skip.withColumn("skip", F.lit(True)), ["doc_id", "page_index"], "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
    left = F.bool_or(~F.col("skip")).over(Window.partitionBy("doc_id"))
    return m.withColumn("left", left).filter(~F.col("skip") | ~F.col("left")).drop("skip", "left")


def truncate_repeats(rows: DataFrame, keep: int = 3) -> DataFrame:
    """Lines without those that repeat the line before more than `keep` times in a row."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    new = F.when(F.col("text").eqNullSafe(F.lag("text").over(w)), 0).otherwise(1)
    isle = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    nth = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no"))
    return isle.withColumn("nth", nth).filter(F.col("nth") <= keep).drop("new", "run", "nth")


def from_anchor(rows: DataFrame, anchors: list[str], lookback: int = 12) -> DataFrame:
    """Lines from `lookback` before the first one with an anchor; all where there is none."""
    hit = F.min(F.when(has_anchor(F.col("text"), anchors), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("hit", hit).filter(F.col("hit").isNull() | (F.col("line_no") >= F.col("hit") - lookback)).drop("hit")


def until_anchor(rows: DataFrame, anchors: list[str]) -> DataFrame:
    """Lines before the first that starts with an anchor (not cut at line 0)."""
    hit = F.min(F.when(starts_with_anchor(F.col("text"), anchors), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("hit", hit).filter(F.col("hit").isNull() | (F.col("hit") == 0) | (F.col("line_no") < F.col("hit"))).drop("hit")


def page_window(pages: DataFrame, start: list[str], end: list[str]) -> DataFrame:
    """Pages from the first with a start anchor to the first later one with an end
    anchor; pages without text stay."""
    w = Window.partitionBy("doc_id")
    p = pages.withColumn("first", F.min(F.when(has_anchor(F.col("text"), start), F.col("page_index"))).over(w))
    ends = has_anchor(F.col("text"), end) & (F.col("page_index") > F.coalesce("first", F.lit(-1)))
    p = p.withColumn("last", F.min(F.when(ends, F.col("page_index"))).over(w))
    inside = (F.col("first").isNull() | (F.col("page_index") >= F.col("first"))) & (F.col("last").isNull() | (F.col("page_index") <= F.col("last")))
    return p.filter(inside | (F.btrim("text") == "")).drop("first", "last")


def join_halves(halves: DataFrame, overlap: int = 3) -> DataFrame:
    """`top` and `bottom` (arrays of lines) as one, without leading lines of the bottom that
    the end of the top holds."""
    tail = F.slice("top", -F.least(F.size("top"), F.lit(overlap)), F.lit(overlap))
    head = F.slice("bottom", 1, overlap)
    drop = F.aggregate(head, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + F.when(a["go"] & F.array_contains(tail, x), 1).otherwise(0)).alias("n"), (a["go"] & F.array_contains(tail, x)).alias("go")), lambda a: a["n"])
    return halves.withColumn("lines", F.concat("top", F.slice(F.col("bottom"), drop + 1, F.greatest(F.size("bottom"), F.lit(1)))))


def read_stats(rows: DataFrame, low: float = 0.6) -> DataFrame:
    """Lines and confidences of a document; only lines below 1 count for the mean."""
    weak = F.when(F.col("conf") < 1, F.col("conf"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("num_lines"), F.round(F.avg(weak), 4).alias("avg_confidence"), F.round(F.min(weak), 4).alias("min_confidence"), F.count_if(F.col("conf") < low).alias("low_lines"))


def segment_confidence(probs: DataFrame) -> DataFrame:
    """Mean probability of the tokens between line breaks (`doc_id, pos, token, p`)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = F.coalesce(F.sum(F.when(F.col("token") == "\n", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return probs.withColumn("segment", s).filter("token <> '\n'").groupBy("doc_id", "segment").agg(F.round(F.avg("p"), 6).alias("conf"))


def own_script(rows: DataFrame) -> DataFrame:
    """Lines that aren't mostly foreign script, foreign characters blanked."""
    return rows.filter(~is_foreign_script_line(F.col("text"))).withColumn("text", strip_foreign_chars(F.col("text")))


def paragraphs(rows: DataFrame) -> DataFrame:
    """Display lines folded into paragraphs: a break at empty lines, headings and bullets."""
    from ..functions.text import heading_level

    w = Window.partitionBy("doc_id").orderBy("line_no")
    empty = F.btrim("text") == ""
    brk = empty | heading_level(F.col("text")).isNotNull() | F.rlike("text", F.lit(r"^\s*([-+*•]|\d{1,2}[.)])\s"))
    p = rows.withColumn("para", F.sum(F.when(brk, 1).otherwise(0)).over(w)).filter(~empty).filter(~F.rlike("text", F.lit(r"^\s*-?\s*\d{1,3}\s*-?\s*$")))
    return p.groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.btrim("text").alias("t")))), lambda s: s["t"]), " ").alias("text"))


def column_segments(boxes: DataFrame, gap: float = 0.03) -> DataFrame:
    """Segments of a band of boxes: a new one where the gap to all boxes on the left is wide."""
    w = Window.partitionBy("doc_id", "band").orderBy("left", "box_id").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("left") - F.max("right").over(w)) > gap, F.lit(True))
    o = Window.partitionBy("doc_id", "band").orderBy("left", "box_id")
    return boxes.withColumn("new", new.cast("int")).withColumn("segment", F.sum("new").over(o)).drop("new")


def inside_region(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes whose centre is inside a normalised rectangle; the y axis of boxes points up."""
    cx, cy = (F.col("left") + F.col("right")) / 2, 1 - (F.col("bottom") + F.col("top")) / 2
    return boxes.filter(cx.between(x0, x1) & cy.between(y0, y1))


def regions(raw: Column) -> Column:
    """Rectangles by page from JSON, corners sorted and clamped, slivers dropped."""
    m = F.from_json(raw, "map<string,array<double>>")
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    good = F.map_filter(m, lambda _, r: F.size(r) == 4)
    fixed = F.transform_values(good, lambda _, r: F.array(unit(F.least(r[0], r[2])), unit(F.least(r[1], r[3])), unit(F.greatest(r[0], r[2])), unit(F.greatest(r[1], r[3]))))
    return F.map_filter(fixed, lambda _, r: (r[2] - r[0] >= 0.01) & (r[3] - r[1] >= 0.01))


def letter_confidence(rows: DataFrame) -> DataFrame:
    """Mean confidence of a document's lines that have a letter (null: none has)."""
    return rows.groupBy("doc_id").agg(F.round(F.avg(F.when(F.rlike("text", F.lit(r"\p{L}")), F.col("conf"))), 4).alias("avg_confidence"))


def verify_text_layer(pages: DataFrame, images: DataFrame, least: float = 0.5) -> DataFrame:
    """`pages` (doc_id, page_index, text, chars, trusted) without trust where a document's densest trusted page
    disagrees with what its image reads (`images`: doc_id, page_index, text). A page that has no
    image text, or either side no words, proves nothing."""
    densest = pages.filter("trusted").groupBy("doc_id").agg(F.max_by(F.struct("page_index", "text"), F.struct("chars", -F.col("page_index"))).alias("p"))
    seen = densest.select("doc_id", "p.*").join(images.withColumnRenamed("text", "image_text"), ["doc_id", "page_index"])
    bad = seen.filter(text_agreement(F.col("text"), F.col("image_text")) < least).select("doc_id", F.lit(True).alias("bad"))
    return pages.join(bad, "doc_id", "left").withColumn("trusted", F.col("trusted") & F.col("bad").isNull()).drop("bad")


def read_hybrid(pages: DataFrame, images: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """`doc_id, page_index, source, text` of every page: trusted pages from their text layer, others from their
    image; pages that neither reads have no row. `required`: documents whose pages all come from images."""
    own = pages
    if required is not None:
        own = own.join(required.select("doc_id").distinct().withColumn("forced", F.lit(True)), "doc_id", "left").withColumn("trusted", F.col("trusted") & F.col("forced").isNull()).drop("forced")
    j = own.join(images.select("doc_id", "page_index", F.col("text").alias("image_text")), ["doc_id", "page_index"], "left")
    source = F.when(F.col("trusted"), "text").when(F.col("image_text").isNotNull(), "image")
    return j.withColumn("source", source).filter("source is not null").select("doc_id", "page_index", "source", F.when(F.col("source") == "text", F.col("text")).otherwise(F.col("image_text")).alias("text"))
