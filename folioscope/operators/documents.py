"""Document summaries, folders and the comparison of readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import kinds
from folioscope.functions.grouping import top_per_group
from folioscope.functions.text import collapse_spaces
from folioscope.session import cut_lineage

SUMMARY_ENGINES = ("docling", "mineru", "infinity")


def document_summaries(
    files: DataFrame, locations: DataFrame, raw: DataFrame, chunks: DataFrame, regions: DataFrame
) -> DataFrame:
    """One row per file: path, reader statuses and errors, chunk and region counts."""
    paths = locations.groupBy("file_hash").agg(F.min("path").alias("path"))
    of_engine = lambda name, value: F.max(F.when(F.col("annotation_engine") == name, F.col(value)))
    readers = raw.groupBy("file_hash").agg(
        *[of_engine(name, "status").alias(f"{name}_status") for name in SUMMARY_ENGINES],
        *[of_engine(name, "error").alias(f"{name}_error") for name in SUMMARY_ENGINES],
    )
    chunk_counts = chunks.groupBy("file_hash").agg(F.count("*").alias("chunk_count"))
    shown = regions.filter(kinds.is_active_engine(F.col("annotation_engine")))
    region_counts = shown.groupBy("file_hash").agg(F.count("*").alias("region_count"))
    joined = files
    for side in (paths, readers, chunk_counts, region_counts):
        joined = joined.join(side, "file_hash", "left")
    return joined.withColumns(
        {"chunk_count": F.coalesce("chunk_count", F.lit(0)), "region_count": F.coalesce("region_count", F.lit(0))}
    )


# --- folders -----------------------------------------------------------------


def path_parts(path: Column) -> Column:
    unified = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.filter(F.split(unified, "/"), lambda part: part != "")


def folder_parts(path: Column) -> Column:
    parts = path_parts(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def common_root(paths: DataFrame, path: str = "path") -> DataFrame:
    """Longest folder prefix all paths share (letter case aside), as one row.

    Per depth the distinct parts are counted; a depth belongs to the root when
    it has one part and every path is that deep.
    """
    folders = paths.select(folder_parts(F.col(path)).alias("_parts")).filter(F.size("_parts") > 0)
    shortest = folders.agg(F.min(F.size("_parts")).alias("n")).scalar()
    deep = folders.select(F.posexplode("_parts").alias("depth", "part"))
    levels = deep.groupBy("depth").agg(F.countDistinct(F.lower("part")).alias("names"), F.min("part").alias("part"))
    split_at = F.min(F.when((F.col("names") > 1) | (F.col("depth") >= shortest), F.col("depth")))
    first_split = levels.agg(F.coalesce(split_at, shortest, F.lit(0)).alias("n")).scalar()
    inside = levels.filter(F.col("depth") < first_split)
    ordered = F.array_sort(F.collect_list(F.struct("depth", "part")))
    return inside.agg(F.transform(ordered, lambda level: level["part"]).alias("root_parts"))


def relative_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``folder_parts``: the folder below the common root, or '(root)'."""
    root = common_root(paths, path).select("root_parts").scalar()
    parts = folder_parts(F.col(path))
    depth = F.coalesce(F.size(root), F.lit(0))
    below = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0)))
    shown = F.when((F.size(parts) >= depth) & (F.size(below) > 0), below).otherwise(F.array(F.lit("(root)")))
    return paths.withColumn("folder_parts", shown)


def folder_stats(documents: DataFrame) -> DataFrame:
    """Totals of every folder over all files below it.

    Needs folder_parts, file_hash, size_bytes, chunk_count, region_count and
    the reader statuses.
    """
    depths = F.sequence(F.lit(1), F.size("folder_parts"))
    prefixes = F.transform(depths, lambda n: F.array_join(F.slice("folder_parts", F.lit(1), n), "/"))
    ready = (F.col("docling_status") == "ok") | (F.col("mineru_status") == "ok")
    sums = ("files", "size_bytes", "chunks", "regions", "ready_documents")
    # files are summed by their own folder first, so only folders are copied to those above them
    own = documents.groupBy("folder_parts", _extension_name()).agg(
        F.count("*").alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("chunk_count").alias("chunks"),
        F.sum("region_count").alias("regions"),
        F.count(F.when(ready, 1)).alias("ready_documents"),
    )
    counted = cut_lineage(own.withColumn("folder", F.explode(prefixes)).groupBy("folder", "_ext").agg(*[F.sum(name).alias(name) for name in sums]))
    totals = counted.groupBy("folder").agg(*[F.sum(name).alias(name) for name in sums])
    parents = counted.select("folder").distinct().select(F.col("folder").alias("_child"), F.split("folder", "/").alias("_p"))
    above = parents.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda n: F.array_join(F.slice("_p", F.lit(1), n), "/"))
        ).alias("folder"),
        "_child",
    ).filter(F.col("folder") != F.col("_child"))
    below = above.groupBy("folder").agg(F.count("*").alias("folders"))
    return (
        totals.join(below, "folder", "left")
        .withColumn("folders", F.coalesce("folders", F.lit(0)))
        .join(_extension_text(counted.withColumnRenamed("files", "_n"), ["folder"]), "folder", "left")
    )


def _extension_name() -> Column:
    name = F.lower(F.trim(F.coalesce("extension", F.lit(""))))
    return F.when(name != "", name).otherwise("(none)").alias("_ext")


def _extension_text(counted: DataFrame, keys: list[str], top: int = 4) -> DataFrame:
    best = top_per_group(counted, keys, [F.col("_n").desc(), F.col("_ext")], top, "_rank")
    items = F.array_sort(F.collect_list(F.struct("_rank", F.concat_ws(" ", "_ext", F.col("_n").cast("string")).alias("t"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(items, lambda item: item["t"]), ", ").alias("extensions"))


def extension_summary(documents: DataFrame, keys: list[str], top: int = 4) -> DataFrame:
    """The most frequent extensions as text, such as '.pdf 12, .png 3'."""
    return _extension_text(documents.groupBy(*keys, _extension_name()).agg(F.count("*").alias("_n")), keys, top)


# --- reader comparison -------------------------------------------------------


def region_stats(regions: DataFrame) -> DataFrame:
    """Regions and pages per file and reader; a missing reader counts as the default one."""
    shown = regions.withColumn("annotation_engine", kinds.engine_or_default(F.col("annotation_engine")))
    shown = shown.filter(F.col("annotation_engine").isin(*kinds.ACTIVE_ENGINES))
    return shown.groupBy("file_hash", "annotation_engine").agg(
        F.count("*").alias("region_count"), F.countDistinct("page_no").alias("region_pages")
    )


def _number(data: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(data, path, "long"), F.lit(0))


def comparison_report(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """What each reader found per file, from its raw row and from its regions."""
    data = F.try_parse_json("output_json")
    pages = F.try_variant_get(data, "$.pages", "array<variant>")
    seconds = F.transform(pages, lambda page: F.try_variant_get(page, "$.elapsed_seconds", "double"))
    timed = F.filter(seconds, lambda value: value.isNotNull())
    elapsed = F.when(F.size(timed) > 0, F.aggregate(timed, F.lit(0.0), lambda total, value: total + value))
    filled = lambda path: F.nullif(F.trim(F.try_variant_get(data, path, "string")), F.lit(""))
    summary = F.try_variant_get(data, "$.agreement_summary", "variant")
    has_summary = F.startswith(F.schema_of_variant(summary), F.lit("OBJECT<")) & (F.schema_of_variant(summary) != "OBJECT<>")
    counts = [
        ("all", "all_source_engines_region_count"),
        ("multi", "multi_engine_region_count"),
        ("single", "single_engine_region_count"),
    ]
    agreement = F.concat_ws(",", *[F.concat(F.lit(f"{name}="), _number(summary, f"$.{key}").cast("string")) for name, key in counts])
    readers = raw.filter(F.col("annotation_engine").isin(*kinds.ACTIVE_ENGINES)).select(
        "file_hash",
        "annotation_engine",
        "status",
        "error",
        "reader_provider",
        "reader_model",
        F.length(F.coalesce("text", F.lit(""))).alias("text_chars"),
        F.size(pages).alias("_json_pages"),
        elapsed.alias("elapsed_seconds"),
        F.coalesce(filled("$.prompt_profile"), filled("$.profile.name")).alias("profile_name"),
        F.when(has_summary, agreement).alias("agreement"),
    )
    # One value as the key: if each side holds a single reader, two keys would be folded to a comparison of constants,
    # and a full join without any key compares every row with every other.
    key = F.struct("file_hash", "annotation_engine")
    match = (F.col("r._key") == F.col("s._key")) & F.col("r.file_hash").isNotNull()
    sides = readers.withColumn("_key", key).alias("r"), region_stats(regions).withColumn("_key", key).alias("s")
    joined = sides[0].join(sides[1], match, "full")
    return joined.select(
        F.coalesce("r.file_hash", "s.file_hash").alias("file_hash"),
        F.coalesce("r.annotation_engine", "s.annotation_engine").alias("annotation_engine"),
        "status",
        F.coalesce("region_count", F.lit(0)).alias("region_count"),
        F.coalesce(F.when(F.col("_json_pages") > 0, F.col("_json_pages")), "region_pages", F.lit(0)).alias("page_count"),
        F.coalesce("text_chars", F.lit(0)).alias("text_chars"),
        "profile_name",
        "elapsed_seconds",
        "agreement",
        "error",
        "reader_provider",
        "reader_model",
    )


def report_lines(report: DataFrame) -> DataFrame:
    """Report rows as tab-separated text."""
    dash = lambda value: F.coalesce(value, F.lit("-"))
    line = F.concat_ws(
        "\t",
        "annotation_engine",
        dash(F.col("status")),
        F.col("region_count").cast("string"),
        F.col("page_count").cast("string"),
        F.col("text_chars").cast("string"),
        dash(F.col("profile_name")),
        dash(F.when(F.col("elapsed_seconds").isNotNull(), F.format_string("%.2f", "elapsed_seconds"))),
        dash(F.col("agreement")),
        dash(collapse_spaces(F.nullif("error", F.lit("")))),
    )
    return report.select("file_hash", "annotation_engine", line.alias("line"))
