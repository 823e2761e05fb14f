"""Reading in rounds: documents that are still open take their next pages, those that have enough leave.

Pages that have to be read from images are the dear part, so none is read after its document ended. A round reads the next
`step` pages of all open documents as one job and writes its lines; a restart finds the rounds that are written and
goes on after them. What a round leaves open is a table of its own (a row a document, with the place of its start anchor), so a
round looks at its own lines only. A document ends at the first page with an end anchor after its start anchor, when all required fields have a value
(looked at after each round), or with its last page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_anchor, starts_with_anchor
from ..sources.cuts import freed, written

PLACE = "struct<page_index: int, line_no: int>"
LINES = "doc_id long, page_index int, line_no int, text string, conf double, round int"


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LINES).parquet(path)
    except AnalysisException:
        return None


def _ended(lines: DataFrame, start: list[str], end: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, s) of the place of each document's start anchor and (doc_id, page_index) of the first page with an end anchor from
    there on (a line that starts with it)."""
    at = F.struct("page_index", "line_no")
    first = lines.filter(has_anchor(F.col("text"), start)).groupBy("doc_id").agg(F.min(at).alias("s")) if start else lines.groupBy("doc_id").agg(F.min(at).alias("s"))
    ends = lines.filter(starts_with_anchor(F.col("text"), end)) if end else lines.limit(0)
    last = ends.join(first, "doc_id").filter(F.struct("page_index", "line_no") > F.col("s")).groupBy("doc_id").agg(F.min("page_index").alias("page_index"))
    return first, last


def read_until(
    docs: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    path: str,
    start: list[str],
    end: list[str],
    complete: Callable[[DataFrame], DataFrame] | None = None,
    step: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(lines, state) of `docs` (`doc_id`, `n_pages`): `doc_id, page_index, line_no, text, conf`, and a row a document with `pages_read`, `stopped_early`.

    `read` gets pages (`doc_id`, `page_index`) and gives their lines; `complete` gets all lines of documents with a start
    anchor and gives the `doc_id` of those whose required fields have values. Anchors are folded, letters and digits only. `path` keeps the rounds: lines of a page
    are written once, so a restart reads no page again."""
    spark = docs.sparkSession
    last_page = docs.agg(F.max("n_pages")).first()[0] or 0
    rounds = -(-last_page // step)
    done_rounds = 0
    for k in range(rounds):
        have = _written(spark, f"{path}/round={k}")
        if have is None:
            break
        done_rounds = k + 1
    open_docs = _open(docs, _so_far(spark, path, done_rounds), start, end, complete, done_rounds * step)
    for k in range(done_rounds, rounds):
        pages = open_docs.select("doc_id", F.explode(F.sequence(F.lit(k * step), (F.least(F.lit((k + 1) * step), F.col("n_pages")) - 1).cast("int"))).alias("page_index"))
        if k and pages.isEmpty():
            break
        lines = read(pages).select("doc_id", "page_index", "line_no", "text", "conf", F.lit(k).alias("round"))
        lines.write.mode("overwrite").parquet(f"{path}/round={k}")
        done_rounds = k + 1
        before = open_docs
        open_docs = written(_still_open(before, spark, path, k, start, end, complete, (k + 1) * step))
        freed(before)
    freed(open_docs)
    every = _so_far(spark, path, done_rounds)
    _, last = _ended(every, start, end)
    lines = every.join(last.withColumnRenamed("page_index", "_last"), "doc_id", "left").filter(F.col("_last").isNull() | (F.col("page_index") <= F.col("_last"))).select("doc_id", "page_index", "line_no", "text", "conf")
    seen = every.groupBy("doc_id").agg(F.max("round").alias("_round"))
    state = docs.join(seen, "doc_id", "left").join(last.withColumnRenamed("page_index", "_last"), "doc_id", "left")
    pages_read = F.least(F.col("n_pages"), (F.coalesce("_round", F.lit(-1)) + 1) * step).cast("long")
    return lines, state.select("doc_id", pages_read.alias("pages_read"), ((pages_read < F.col("n_pages")) | (F.col("_last") < F.col("n_pages") - 1)).alias("stopped_early")).fillna(False, ["stopped_early"])


def _so_far(spark: SparkSession, path: str, rounds: int) -> DataFrame:
    if not rounds:
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).parquet(*[f"{path}/round={k}" for k in range(rounds)])


def _open(docs: DataFrame, lines: DataFrame, start: list[str], end: list[str], complete: Callable[[DataFrame], DataFrame] | None, from_page: int) -> DataFrame:
    """Documents with pages from `from_page` on that have neither ended nor all they need, and where their start anchor is
    (`s`). A page without lines doesn't end a document."""
    left = docs.select("doc_id", "n_pages").filter(F.col("n_pages") > from_page)
    if not from_page:
        return left.withColumn("s", F.lit(None).cast(PLACE))
    first, last = _ended(lines, start, end)
    left = left.join(last, "doc_id", "left_anti").join(first, "doc_id", "left")
    return _incomplete(left, lambda: lines, complete)


def _still_open(open_docs: DataFrame, spark: SparkSession, path: str, k: int, start: list[str], end: list[str], complete: Callable[[DataFrame], DataFrame] | None, from_page: int) -> DataFrame:
    """What round `k` leaves of `open_docs`: as `_open`, from the lines of this round."""
    at = F.struct("page_index", "line_no")
    starts = F.when(has_anchor(F.col("text"), start), at) if start else at
    ends = F.when(starts_with_anchor(F.col("text"), end), at) if end else F.lit(None).cast(PLACE)
    own = spark.read.schema(LINES).parquet(f"{path}/round={k}").groupBy("doc_id").agg(F.min(starts).alias("_s"), F.max(ends).alias("_e"))
    left = open_docs.filter(F.col("n_pages") > from_page).join(own, "doc_id", "left").withColumn("s", F.coalesce("s", "_s"))
    return _incomplete(left.filter(~F.coalesce(F.col("_e") > F.col("s"), F.lit(False))).drop("_s", "_e"), lambda: _so_far(spark, path, k + 1), complete)


def _incomplete(left: DataFrame, lines: Callable[[], DataFrame], complete: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    if complete is None:
        return left
    ready = complete(lines().join(left.filter("s is not null").select("doc_id"), "doc_id", "left_semi"))
    return left.join(ready.select("doc_id").distinct(), "doc_id", "left_anti")
