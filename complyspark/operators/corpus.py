"""The regulation corpus: chunks, registry, fingerprints, upserts, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, content_hash
from ..sources.cuts import written

STATUSES = ("missing_file", "hash_mismatch", "unapproved", "unregistered", "ok")


def chunk_paragraphs(docs: DataFrame, separator: str = "\n\n", max_chars: int = 1200) -> DataFrame:
    """`doc_id, chunk_index, text`: paragraphs packed greedily up to `max_chars`; a longer one stays whole.

    Where chunks start depends on all paragraphs before, so it is a fold over lengths that keeps a number a chunk; a
    chunk is then one slice of the paragraphs."""
    paras = F.filter(F.transform(F.split("text", separator), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    state = F.struct(F.lit(-1).alias("c"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def place(acc: Column, n: Column) -> Column:
        fits = (acc["c"] >= 0) & (acc["n"] + n + len(separator) <= max_chars)
        return F.struct(
            F.when(fits, acc["c"]).otherwise(acc["c"] + 1).alias("c"),
            F.when(fits, acc["n"] + n + len(separator)).otherwise(n).alias("n"),
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
            (acc["i"] + 1).alias("i"),
        )

    starts = F.aggregate(F.transform(paras, lambda p: F.length(p)), state, place, lambda acc: F.concat(acc["starts"], F.array(acc["i"])))
    packed = docs.select("doc_id", starts.alias("s"), paras.alias("p")).filter(F.size("p") > 0)
    texts = F.transform(F.slice("s", 1, F.size("s") - 1), lambda a, k: F.array_join(F.slice("p", a + 1, F.get("s", k + 1) - a), separator))
    return packed.select("doc_id", F.posexplode(texts).alias("chunk_index", "text"))


def with_chunk_ids(chunks: DataFrame, source: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(source, F.col("chunk_index"), F.col("text")))


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with rows of equal key replaced and others added."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def prune_orphans(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows whose segment still exists; all of them where there is no segment at all."""
    any_segment = segments.agg((F.count("*") > 0).alias("some"))
    marked = rows.join(segments.select("segment_id").distinct().withColumn("live", F.lit(True)), "segment_id", "left").crossJoin(F.broadcast(any_segment))
    return marked.filter(F.col("live") | ~F.col("some")).drop("live", "some")


def registry_audit(registry: DataFrame, files: DataFrame) -> DataFrame:
    """`file, status` of every registered or found file: a full outer join, one status each."""
    r = registry.select("file", F.col("sha256").alias("declared"), "approved_by", F.lit(True).alias("registered"))
    f = files.select("file", F.col("sha256").alias("actual"))
    j = r.join(f, "file", "full_outer")
    status = (
        F.when(F.col("registered").isNull(), "unregistered")
        .when(F.col("actual").isNull(), "missing_file")
        .when(F.col("declared").isNotNull() & (F.col("declared") != F.col("actual")), "hash_mismatch")
        .when(F.coalesce("approved_by", F.lit("")) == "", "unapproved")
        .otherwise("ok")
    )
    return j.select("file", status.alias("status"))


def status_counts(audit: DataFrame) -> DataFrame:
    """A count for every status, 0 included, and whether it blocks."""
    spark = audit.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, ord int")
    n = audit.groupBy("status").agg(F.count("*").alias("c"))
    return F.broadcast(dim).join(n, "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"), F.col("status").isin("missing_file", "hash_mismatch").alias("blocking"))


def registry_sync(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry with null hashes filled in and unknown files added, unapproved."""
    filled = registry.join(files.select("file", F.col("sha256").alias("actual")), "file", "left").select("file", F.coalesce("sha256", "actual").alias("sha256"), "approved_by")
    new = files.join(registry, "file", "left_anti").select("file", "sha256", F.lit(None).cast("string").alias("approved_by"))
    return filled.unionByName(new)


def approve(registry: DataFrame, files: DataFrame, names: list[str], who: str) -> DataFrame:
    """Named entries get the current hash and the approver."""
    j = registry.join(files.select("file", F.col("sha256").alias("actual")), "file", "left")
    hit = F.col("file").isin(names) & F.col("actual").isNotNull()
    return j.select("file", F.when(hit, F.col("actual")).otherwise(F.col("sha256")).alias("sha256"), F.when(hit, who).otherwise(F.col("approved_by")).alias("approved_by"))


LANES = 4


def fingerprint(docs: DataFrame, *constants: str) -> DataFrame:
    """16 hex digits of a hash that doesn't depend on row order: the lines' hashes are summed modulo 2 ** 60 in LANES
    lanes of 15 hex digits each, in partial aggregates, and the sums are hashed. One row, whatever the corpus holds."""
    line = F.sha2(F.concat_ws("|", "file", "sha256"), 256)
    lane = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    total = lambda k: F.coalesce(F.sum(lane(k)), F.lit(0)) % F.lit(2**60)
    sums = docs.select(line.alias("h")).agg(F.count("*").alias("n"), *[total(k).cast("decimal(20,0)").alias(f"s{k}") for k in range(LANES)])
    return sums.select(F.substring(F.sha2(F.concat_ws("#", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(LANES)], *[F.lit(c) for c in constants]), 256), 1, 16).alias("fingerprint"))


def regulation_sets(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Sets with the number of their files on disk and titles in registry order."""
    live = registry.join(files.select("file"), "file", "left_semi")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda s: s["title"])
    return live.groupBy("reg_set").agg(F.count("*").alias("files"), titles.alias("titles"))


def add_to_set(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New documents whose content the set doesn't hold yet, each content once, under free names in the order of `ord`: a stem that is
    taken gets the first number from 2 on that makes it free, and names given before count as taken.

    A stem gives itself or itself with a number, so stems are named apart, each upload by its place among those of its stem, unless one stem
    is what another one gives: such linked stems are one fold over their uploads. Of the names taken just those that a stem
    would give are looked at, and just as many free numbers are kept as its uploads can need.

    Rows without a stem get no name."""
    w = Window.partitionBy("reg_set", "sha256").orderBy("ord")
    fresh = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(registry.select("reg_set", "sha256"), ["reg_set", "sha256"], "left_anti")
    fresh = written(fresh)
    numbered = r"(?s)\A(.*)_([2-9]|[1-9]\d{1,8})\z"  # what a stem gives from 2 on
    base = lambda c: F.when(F.rlike(c, F.lit(numbered)), F.regexp_extract(c, numbered, 1))
    number = lambda c: F.nullif(F.regexp_extract(c, numbered, 2), F.lit("")).cast("int")
    stems = fresh.filter("stem is not null").groupBy("stem").agg(F.count("*").alias("_asks"))

    # The family of a stem: from it upwards as long as stems are asked for.
    above = F.filter(F.aggregate(F.sequence(F.lit(1), F.size(F.split("stem", "_"))), F.array("stem"), lambda acc, _: F.concat(acc, F.array(base(F.element_at(acc, -1))))), lambda x: x.isNotNull())
    chain = stems.select("stem", F.posexplode(above).alias("_up", "_above")).join(stems.select(F.col("stem").alias("_above")), "_above")
    reach = chain.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("_up", "_above"))).alias("_chain"))
    root = F.element_at(F.filter("_chain", lambda x, i: x["_up"] == i), -1)["_above"]
    family = reach.select("stem", root.alias("_f")).join(stems, "stem")
    size = family.groupBy("_f").agg(F.count("*").alias("_stems"), F.sum("_asks").alias("_most"))
    family = written(family.join(size, "_f"))

    # The names each stem may give, in order: itself (number 1) and free numbers, from the gaps between numbers that are taken.
    names = registry.select("file").distinct()
    taken = names.select(F.explode(F.array(F.struct(F.col("file").alias("stem"), F.lit(1).alias("_k")), F.struct(base(F.col("file")).alias("stem"), number(F.col("file")).alias("_k")))).alias("_t")).select("_t.*")
    held = family.join(taken, "stem").select("stem", "_most", "_k").unionByName(family.select("stem", "_most", F.lit(0).alias("_k")))
    by_number = Window.partitionBy("stem").orderBy("_k")
    gaps = held.withColumn("_next", F.lead("_k").over(by_number)).withColumn("_before", F.col("_k") + 1 - F.row_number().over(by_number)).filter(F.col("_before") < F.col("_most"))
    last = F.least(F.coalesce(F.col("_next") - 1, F.lit(2**31 - 2)), F.col("_k") + F.col("_most") - F.col("_before")).cast("int")
    free = gaps.filter(F.coalesce(F.col("_next") > F.col("_k") + 1, F.lit(True))).select("stem", "_before", F.posexplode(F.sequence(F.col("_k") + 1, last)).alias("_i", "_k"))
    free = free.select("stem", (F.col("_before") + F.col("_i") + 1).alias("_place"), F.when(F.col("_k") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", "_k")).alias("_file"))

    own = fresh.withColumn("_row", F.struct(*[F.col(c) for c in fresh.columns]))
    columns = [F.col(f"_row.{c}").alias(c) for c in fresh.columns if c != "file"]
    alone = family.filter("_stems = 1").select("stem")
    place = F.row_number().over(Window.partitionBy("stem").orderBy("ord"))
    apart = own.join(alone, "stem").withColumn("_place", place).join(free, ["stem", "_place"]).select(*columns, F.col("_file").alias("file"))
    nameless = own.filter("stem is null").select(*columns, F.lit(None).cast("string").alias("file"))

    given = family.filter("_stems > 1").select("_f", "stem").join(free, "stem").groupBy("_f", "stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_file"))), lambda x: x["_file"]).alias("_names"))
    given = given.groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("stem", "_names"))).alias("_given"))
    uploads = own.join(family.filter("_stems > 1").select("_f", "stem"), "stem").groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("ord", "stem", "_row")), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).when(a["stem"] < b["stem"], -1).otherwise(1)).alias("_asked"))
    at = F.transform("_asked", lambda x: F.array_position(F.transform("_given", lambda g: g["stem"]), x["stem"]).cast("int"))
    j = uploads.join(given, "_f").withColumn("_at", at).withColumn("_shared", F.transform("_given", lambda g: g["stem"]))
    start = F.struct(F.transform("_given", lambda g: F.lit(1)).alias("next"), F.array().cast("array<string>").alias("gone"), F.array().cast("array<string>").alias("files"))

    def step(acc: Column, k: Column) -> Column:
        """The first name of the stem from its next place on that no other stem of the family was given; those that others could be given are kept in `gone`."""
        before = F.element_at(acc["next"], k)
        tried = F.slice(F.element_at(F.col("_given"), k)["_names"], before, F.size(acc["gone"]) + 1)
        skipped = F.aggregate(tried, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + F.when(a["go"] & F.array_contains(acc["gone"], x), 1).otherwise(0)).alias("n"), (a["go"] & F.array_contains(acc["gone"], x)).alias("go")), lambda a: a["n"])
        one = F.array(F.struct(skipped.alias("s"), F.get(tried, skipped).alias("file")))
        return F.get(
            F.transform(
                one,
                lambda o: F.struct(
                    F.transform(acc["next"], lambda n, i: F.when(i == k - 1, n + o["s"] + 1).otherwise(n)).alias("next"),
                    F.when(F.array_contains("_shared", o["file"]), F.concat(acc["gone"], F.array(o["file"]))).otherwise(acc["gone"]).alias("gone"),
                    F.concat(acc["files"], F.array(o["file"])).alias("files"),
                ),
            ),
            0,
        )

    folded = j.select("_asked", F.aggregate("_at", start, step, lambda acc: acc["files"]).alias("_files"))
    linked = folded.select(F.explode(F.arrays_zip("_asked", "_files")).alias("x")).select(F.col("x._asked._row").alias("_row"), F.col("x._files").alias("file")).select(*columns, "file")
    return apart.unionByName(linked).unionByName(nameless)


def delete_set(registry: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(the registry without the set, the files that no other entry uses)."""
    rest = registry.filter(F.col("reg_set") != name)
    gone = registry.filter(F.col("reg_set") == name).select("file").distinct().join(rest.select("file"), "file", "left_anti")
    return rest, gone


def unlink_set(field_sets: DataFrame, name: str) -> DataFrame:
    return field_sets.withColumn("regulation_sets", F.array_remove("regulation_sets", name))


def used_by(field_sets: DataFrame, sets: DataFrame) -> DataFrame:
    return field_sets.select("field_set_id", F.explode("regulation_sets").alias("reg_set")).join(sets.select("reg_set").distinct(), "reg_set").groupBy("reg_set").agg(F.array_sort(F.collect_set("field_set_id")).alias("used_by"))


def plan_entries(files: DataFrame, registry: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Registry values win, else inferred ones; default validity from 2000-01-01."""
    from ..functions.text import infer_doc_type, title_of

    r = registry.select("file", F.nullif("title", F.lit("")).alias("r_title"), F.nullif("doc_type", F.lit("")).alias("r_type"), F.nullif("effective_from", F.lit("")).alias("r_from"))
    j = files.join(r, "file", "left")
    return j.select("file", F.coalesce("r_title", title_of(F.col("file"), F.col("text"))).alias("title"), F.coalesce("r_type", infer_doc_type(F.col("file"), rules, "other")).alias("doc_type"), F.coalesce("r_from", F.lit("2000-01-01")).alias("effective_from"))


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("file", content_hash(F.col("text")).alias("sha256"))


def chunk_metadata(files: DataFrame, registry: DataFrame) -> DataFrame:
    """`file` with what the registry says of it, '' where it says nothing or has no such column."""
    known = set(registry.columns)
    own = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in known else F.lit("")).alias(c)
    names = ("doc_no", "official_source", "corpus_version", "approved_by", "approved_at", "reg_set")
    return files.join(registry, "file", "left").select("file", *[own(c) for c in names[:-1]], F.substring(F.coalesce("sha256", F.lit("")), 1, 16).alias("content_sha256"), own("reg_set"))


def audit_order(audit: DataFrame) -> DataFrame:
    """An audit with its place: the gravest status first, then by file."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return audit.withColumn("severity", place.cast("int")).orderBy("severity", "file")


def active_set(sets: DataFrame, saved: str) -> DataFrame:
    """`id` of the check set in use: the saved one if it is usable, else the user's latest, else the first by id
    (`sets`: id, source, mtime, usable)."""
    own = F.col("source") == "user"
    pick = F.coalesce(F.max(F.when(F.col("id") == saved, F.col("id"))), F.max_by(F.when(own, F.col("id")), F.when(own, F.struct("mtime", "id"))), F.min("id"), F.lit(""))
    return sets.filter("usable").agg(pick.alias("id"))


def corpus_texts(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """`text`: all texts that teach spelling, of the corpus and of check sets, each once."""
    return chunks.select("text").unionByName(settings.select("text")).filter(F.btrim("text") != "").distinct()


def seed(files: DataFrame, registry: DataFrame, require_approval: bool = False, only: list[str] | None = None, max_chars: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(chunks, skipped): chunks of the files (`file, text, sha256`) with ids and metadata, and files left out with
    their status. `only` loads just these, to be upserted; without approval asked for, nothing is skipped."""
    own = files if only is None else files.filter(F.col("file").isin(only))
    status = own.select("file").join(registry_audit(registry, files), "file")
    skipped = status.filter(F.col("status") != "ok") if require_approval else status.limit(0)
    loaded = own.join(skipped.select("file"), "file", "left_anti")
    meta = chunk_metadata(loaded.select("file"), registry)
    chunks = chunk_paragraphs(loaded.select(F.col("file").alias("doc_id"), "text"), max_chars=max_chars).withColumnRenamed("doc_id", "file")
    return with_chunk_ids(chunks, F.col("file")).join(meta, "file"), skipped


def reset(chunks: DataFrame, path: str) -> None:
    """A store that holds `chunks` and nothing else; plans that read the old one see the new one."""
    chunks.write.mode("overwrite").parquet(path)
    chunks.sparkSession.catalog.refreshByPath(path)
