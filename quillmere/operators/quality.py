"""Data quality profiles and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillmere.functions import text as tx
from quillmere.functions.scalars import before
from quillmere.sources.jdbc import union_sources

# The gate thresholds of the example configuration.
MIN_LENGTH = 100
MAX_LENGTH = 1_000_000
NULL_PERCENT = 20.0
DUPLICATE_PERCENT = 5.0
# The file rules.
FILE_MIN_BYTES = 100
FILE_MAX_BYTES = 100_000_000
FILE_MIN_LENGTH = 50
FILE_EXTENSIONS = (".txt", ".pdf", ".docx", ".md", ".json")
FILE_REQUIRED = ("source", "upload_date")


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, share of empty cells and repeated rows in one shuffle, of
    a digest of each row: equal rows are counted together before it."""
    columns = df.columns
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in columns), F.lit(0))
    return (
        df.select(F.sha2(F.to_json(F.struct(*[f"`{c}`" for c in columns])), 256).alias("_row"), nulls.alias("_nulls"))
        .groupBy("_row")
        .agg(F.count("*").alias("_n"), F.sum("_nulls").alias("_nulls"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.sum("_nulls").alias("_nulls"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .select(
            F.lit(name).alias("asset"),
            "row_count",
            F.lit(len(columns)).alias("column_count"),
            F.try_divide(F.col("_nulls") * 100.0, F.col("row_count") * len(columns)).alias("null_percentage"),
            "duplicate_rows",
        )
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return union_sources([profile_table(df, name) for name, df in tables.items()])


def gate_tables(
    profiles: DataFrame, null_limit: float = NULL_PERCENT, duplicate_limit: float = DUPLICATE_PERCENT
) -> DataFrame:
    share = F.try_divide(F.col("duplicate_rows") * 100.0, F.col("row_count"))
    return profiles.withColumns(
        {
            "duplicate_percentage": share,
            "passed": F.coalesce(
                (F.col("null_percentage") <= null_limit) & (share <= duplicate_limit), F.lit(False)
            ),
        }
    )


def _first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    failing = F.lit(None).cast("string")
    for reason, ok in reversed(checks):
        failing = F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).otherwise(failing)
    return failing


def gate_rows(
    df: DataFrame,
    content_col: str = "content",
    required: Sequence[str] = ("content", "title"),
    low: int = MIN_LENGTH,
    high: int = MAX_LENGTH,
) -> DataFrame:
    """Add quality_error (first failed rule) and quality_ok."""
    length = F.char_length(content_col)
    checks = [(f"missing {c}", F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in required]
    checks += [("too short", length >= low), ("too long", length <= high)]
    error = _first_failure(checks)
    return df.withColumns({"quality_error": error, "quality_ok": error.isNull()})


def gate_files(files: DataFrame) -> DataFrame:
    """File rules: size, extension, content length and required metadata.
    Needs file_path, file_size, content and a metadata map."""
    checks = [
        ("file size", F.col("file_size").between(FILE_MIN_BYTES, FILE_MAX_BYTES)),
        ("extension", tx.file_extension(F.col("file_path")).isin(*FILE_EXTENSIONS)),
        ("content length", F.char_length("content") >= FILE_MIN_LENGTH),
        *[(f"metadata {m}", F.try_element_at("metadata", F.lit(m)).isNotNull()) for m in FILE_REQUIRED],
    ]
    error = _first_failure(checks)
    return files.withColumns({"quality_error": error, "quality_ok": error.isNull()})


def created_on(assets: DataFrame, day) -> DataFrame:
    return assets.filter(F.to_date("created_at") == F.lit(day).cast("date"))


def split_by_age(df: DataFrame, as_of, days: int, column: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Rows kept by a retention of ``days`` and the expired ones."""
    cut = before(F.lit(as_of).cast("timestamp_ntz"), days=days)
    expired = F.coalesce(F.col(column) < cut, F.lit(False))
    return df.filter(~expired), df.filter(expired)
