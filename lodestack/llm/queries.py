"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.catalogue import extension_of, last_segment
from lodestack.functions.text import clean_extension, strip
from lodestack.llm import leakage, lookalikes, mixing, percentiles, reading_level, terms
from lodestack.operators import snapshots
from lodestack.plans import catalogue
from lodestack.session import shared_path, write_once
from lodestack.sources.tables import table

SHARES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _extension_counts(spark: SparkSession, d: str) -> DataFrame:
    """The files of the last month (by ``scanned_at``) are an increment to the counts of all before."""
    files = table(spark, d, "files")
    since = files.agg(F.date_trunc("month", F.max("scanned_at")).cast("timestamp_ntz").alias("m")).first()["m"]
    return terms.load_and_increment(files, F.col("id"), clean_extension(F.col("extension")), "scanned_at", since)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.mark_terms(_extension_counts(spark, d), 5, 0.1)
    return marked.where("mark IS NOT NULL").select(F.col("term").alias("extension"), "mark")


def p1_extension_counts(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.mark_terms(_extension_counts(spark, d), 5, 0.1)
    return marked.select(F.col("term").alias("extension"), F.col("occurrences").alias("row_count"), F.col("records").alias("file_count"), "mark")


def p1_after_scans(spark: SparkSession, d: str) -> DataFrame:
    """Extensions of what the volumes' scans before the last found, moved on by what the last scans changed.

    Only the files that a scan added, removed or changed are aggregated; those removed count with a minus.
    """
    record, extension = F.struct("volume_id", "relative_path"), clean_extension(extension_of(last_segment(F.col("relative_path"))))
    store = terms.TermCounts(spark, shared_path(spark, "terms"))
    store.apply("before", None, catalogue.last_scans(spark, d, 1), record, extension)
    sequence = snapshots.completed_sequence(table(spark, d, "scan_history"))
    last = sequence.groupBy("volume_id").agg(F.max("position").alias("position"))
    moved = snapshots.scan_changes(table(spark, d, "file_snapshots"), table(spark, d, "scan_history")).join(sequence.join(last, ["volume_id", "position"]).select("scan_id"), "scan_id")
    moved = write_once(moved.select("volume_id", "relative_path", "change_type"), "changes")
    store.apply("last", moved.where("change_type <> 'added'"), moved.where("change_type <> 'removed'"), record, extension)
    return store.counts().where("level = 'term'").select(F.col("term").alias("extension"), F.col("records").alias("file_count"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").where("size_bytes >= 0")
    return files.select("id", "volume_id", clean_extension(F.col("extension")).alias("extension"), "size_bytes")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    with_extension = _sized(spark, d).where("extension IS NOT NULL")
    found = percentiles.outlying_groups(with_extension, ["volume_id", "extension"], "extension", F.col("size_bytes"), ["id"], 20, 8.0)
    return found.select("volume_id", "extension")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per pair, per extension and per volume, the coarser ones combined from the pairs' buffers."""
    pair = ["volume_id", "extension"]
    buffers = percentiles.sketch(_sized(spark, d), pair, F.col("size_bytes"), ["id"])
    nothing = {"volume_id": F.lit(None).cast("bigint"), "extension": F.lit(None).cast("string")}
    level = lambda name, *kept: F.struct(
        F.lit(name).alias("level"), *[(F.col(c) if c in kept else nothing[c]).alias(c) for c in pair]
    )
    levels = F.array(level("pair", *pair), level("extension", "extension"), level("volume", "volume_id"))
    groups = ["level", *pair]
    spread = buffers.select(F.explode(levels).alias("g"), "value", "weight", "error").select("g.*", "value", "weight", "error")
    out = percentiles.percentiles(percentiles.combine(spread, groups), groups, SHARES)
    return out.select(
        *groups, "share", F.col("value").alias("size_bytes"), F.col("rows").cast("bigint").alias("file_count"), F.col("rank_error").cast("bigint").alias("rank_error")
    )


#: Elements of a buffer that makes every larger group of the smallest test data collapse.
SMALL_BUFFER = 64


def p2_error_bound(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per extension from small buffers, combined from those of pairs, checked against all sizes: whether the
    asked rank lies within the stated error of the ranks that the given size has."""
    pair = ["volume_id", "extension"]
    sized = _sized(spark, d).where("extension IS NOT NULL")
    buffers = percentiles.sketch(sized, pair, F.col("size_bytes"), ["id"], SMALL_BUFFER)
    found = percentiles.percentiles(percentiles.combine(buffers.drop("volume_id"), ["extension"], SMALL_BUFFER), ["extension"], SHARES)
    asked = write_once(found, "percentiles").groupBy("extension").agg(F.collect_list(F.struct("share", "value", "rows", "rank_error")).alias("asked"))  # one row per share
    each = sized.select("extension", "id", "size_bytes").distinct().join(asked, "extension").select("extension", "size_bytes", F.explode("asked").alias("a"))
    counts = [F.count_if(F.col("size_bytes") < F.col("a.value")).alias("below"), F.count_if(F.col("size_bytes") <= F.col("a.value")).alias("upto")]
    ranked = each.groupBy("extension", "a.share", "a.rows", "a.rank_error").agg(*counts)
    rank = F.greatest(F.ceil(F.col("share") * F.col("rows")), F.lit(1))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return ranked.select("extension", "share", F.col("rows").cast("bigint").alias("file_count"), (F.col("rank_error") > 0).alias("collapsed"), (off <= F.col("rank_error")).alias("within"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files = lookalikes.lookalike_pairs(table(spark, d, "files"), "volume_id", "relative_path", "id")
    folders = lookalikes.lookalike_pairs(table(spark, d, "folders"), "parent_id", "name", "id")
    named = [x.select(F.lit(kind).alias("record_kind"), "id_a", "id_b") for kind, x in (("file", files), ("folder", folders))]
    return named[0].unionByName(named[1])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every file and folder that looks like another one of its volume or folder, with its class."""
    files = lookalikes.lookalike_classes(table(spark, d, "files"), "volume_id", "relative_path", "id")
    folders = lookalikes.lookalike_classes(table(spark, d, "folders"), "parent_id", "name", "id")
    named = [x.select(F.lit(kind).alias("record_kind"), "id", "class_id") for kind, x in (("file", files), ("folder", folders))]
    return named[0].unionByName(named[1])


def p3_misleading_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of file and folder names that mix scripts or can be read as Latin, with the number of records that hold them."""
    kinds = [lookalikes.misleading_tokens(table(spark, d, n), "name", "id").withColumn("record_kind", F.lit(k)) for n, k in (("files", "file"), ("folders", "folder"))]
    return kinds[0].unionByName(kinds[1]).groupBy("record_kind", "token", "kind", "spelling").agg(F.count(F.lit(1)).alias("records"))


def p3_folder_names(spark: SparkSession, d: str) -> DataFrame:
    """Every folder name in its one form, with whether that changed it."""
    form = lookalikes.canonical(F.col("name"))
    return table(spark, d, "folders").select("id", form.alias("one_form"), (~form.eqNullSafe(F.col("name"))).alias("changed")).distinct()


def _leak_tables(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(*_leak_tables(spark, d), 12)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that it leaked into."""
    return leakage.leak_report(leakage.leaked_items(*_leak_tables(spark, d), 12), table(spark, d, "eval_items"), "item_id")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents with the leaked spans cut out."""
    return leakage.without_leaks(*_leak_tables(spark, d), 12)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lengths = mixing.stored_lengths(table(spark, d, "documents"), "doc_id", "source", "text")
    return lengths, mixing.mixing_plan(lengths, table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the choice takes all that the cap allows and still misses the target."""
    return mixing.mixing_report(_plan(spark, d)[1]).where("unreachable").select("source_name")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixing_report(_plan(spark, d)[1])


def _characters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Characters as the measure of size, which SQL can count too."""
    lengths = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_tokens"))
    return lengths, mixing.mixing_plan(lengths, table(spark, d, "mix_targets"))


def p7_report_by_characters(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mixing_report(_characters(spark, d)[1])
    return report.select("source_name", "budget", "source_tokens", "documents", "chosen_tokens", "exact", "unreachable", F.round("reached_share", 9).alias("reached_share"))


def p7_selection_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """What the documents selected add up to, per source, and whether each is there once and not above the cap."""
    lengths, plan = _characters(spark, d)
    chosen = mixing.chosen_documents(lengths, plan, "doc_id", seed=7)
    caps = plan.select("source_name", "max_repeats").distinct()
    sums = chosen.join(caps, "source_name").groupBy("source_name").agg(
        F.sum(F.col("n_tokens") * F.col("times")).cast("bigint").alias("chosen_tokens"), F.bool_and(F.col("times") <= F.col("max_repeats")).alias("within_cap"), (F.count_distinct("doc_id") == F.count("doc_id")).alias("once")
    )
    return sums.where("chosen_tokens > 0")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    lengths, plan = _plan(spark, d)
    return mixing.chosen_documents(lengths, plan, "doc_id", seed=7)


def _levels(spark: SparkSession, d: str, within: float = reading_level.WITHIN) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_grades"), "rater", "grade", within=within)


#: Level from which a document may be demanding. Levels of documents that are lie far above (see the README).
CANDIDATE_LEVEL = 2.5


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a high level, checked exactly by words, sentences and long words.

    Documents whose level says nothing about their text (graded by a person, or linked to no other) are checked too.
    """
    candidates = _levels(spark, d).where((F.col("level") >= CANDIDATE_LEVEL) | F.col("level").isNull() | F.col("graded"))
    return candidates.where("n_words >= 40 AND lix >= 55").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, 1e-5).select("doc_id", F.round("level", 2).alias("level"), "graded", "n_words", F.round("lix", 2).alias("lix"), "converged")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, language and whole level."""
    key = lambda c: F.lower(strip(F.col(c))).alias(c)
    docs = table(spark, d, "documents").select("doc_id", key("source"), key("lang"))
    levels = _levels(spark, d, 1e-5).select("doc_id", F.round("level").cast("int").alias("level"))
    return docs.join(levels, "doc_id").groupBy("source", "lang", "level").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_extension_counts, p1_after_scans, p2_found, p2_percentiles, p2_error_bound, p3_found, p3_classes, p3_misleading_tokens, p3_folder_names, p6_found, p6_items, p6_cleaned, p7_found, p7_report, p7_report_by_characters, p7_selection, p7_selection_by_characters, p8_found, p8_levels, p8_profile)
    return {f.__name__: f for f in named}
