"""Ids that depend on content only, so that a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identity of each reader and of each Markdown generator.
ENGINE_IDENTITIES = (
    ("docling", "local-docling", "docling", "local:docling"),
    ("docling_normalized", "local-docling", "docling-normalized-jpg", "local:docling_normalized"),
    ("mineru", "local-mineru", "mineru-{backend}", "local:mineru:{backend}"),
    ("mineru_normalized", "local-mineru", "mineru-{backend}-normalized-jpg", "local:mineru_normalized:{backend}"),
    ("infinity", "local-infinity-parser2", "{model}", "local:infinity:{backend}:{model}"),
    ("infinity_markdown", "local-infinity-parser2", "{model}", "local:infinity_markdown:{backend}:{model}"),
    ("markitdown", "local-markitdown", "markitdown-ocr", "local:markitdown"),
    ("markitdown_cu", "azure-content-understanding", "markitdown-content-understanding", "local:markitdown_cu"),
)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(file_hash: Column, index: Column) -> Column:
    """File and position: unique at any scale, unlike a 64-bit hash."""
    return F.concat_ws(":", file_hash, index.cast("string"))


def thousandths(value: Column) -> Column:
    """Rounded half away from zero, as ``round`` does, but without a decimal number for each value."""
    scaled = value * 1000
    whole = scaled.cast("long")
    rest = scaled - whole
    return whole + F.when(rest >= 0.5, 1).when(rest <= -0.5, -1).otherwise(0)


def box_key(ref: Column, page_no: Column, box: Column) -> Column:
    """Key of a box on a page, coordinates rounded to three places."""
    return F.struct(
        ref.alias("ref"),
        page_no.cast("int").alias("page_no"),
        *[thousandths(box[side]).alias(side) for side in ("left", "top", "right", "bottom")],
    )


def region_id(file_hash: Column, engine: Column, ref: Column, page_no: Column, box: Column) -> Column:
    sides = [thousandths(box[side]).cast("string") for side in ("left", "top", "right", "bottom")]
    key = F.concat_ws("|", file_hash, engine, ref, page_no.cast("string"), *sides)
    return F.substring(F.sha2(key, 256), 1, 32)


def term_id(region: Column, char_start: Column) -> Column:
    return F.sha2(F.concat_ws("|", region, char_start.cast("string")), 256)


def work_key(phase: Column, engine: Column, file_hash: Column, profile: Column | None = None) -> Column:
    parts = [phase, engine] + ([] if profile is None else [F.when(profile != "", profile)]) + [file_hash]
    return F.concat_ws(":", *parts)


def engine_identity(df: DataFrame, engine: str = "engine", backend: str = "pipeline", model: str = "parser") -> DataFrame:
    """Adds provider, model and execution_key of each engine."""
    name = F.col(engine)

    def pick(position: int) -> Column:
        texts = [(row[0], row[position].format(backend=backend, model=model)) for row in ENGINE_IDENTITIES]
        return F.coalesce(*[F.when(name == key, F.lit(text)) for key, text in texts])

    return (
        df.withColumn("provider", F.coalesce(pick(1), F.lit("local")))
        .withColumn("model", F.coalesce(pick(2), name))
        .withColumn("execution_key", F.coalesce(pick(3), F.concat(F.lit("local:"), name)))
    )


def server_execution_key(base_url: Column, model: Column) -> Column:
    """Execution key of a model behind a shared model server."""
    return F.concat_ws(":", F.lit("lmstudio"), F.rtrim(base_url, F.lit("/")), model)


def next_id(df: DataFrame, column: str) -> int:
    """max(id) + 1; one number, read once per run."""
    return int(df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("n")).first()["n"])
