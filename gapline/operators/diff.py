"""Strict comparison of tables, digests of their content, and checks of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_tables(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """One row a column: how many cells are equal, differ, differ beyond the tolerance, and lack a partner row; the largest difference.

    A tolerance never makes cells equal; it only tells how far they are apart.
    Two nulls, and two NaN, are equal. Keys must be unique in both tables.
    """
    a = actual.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in columns), F.lit(True).alias("__ina"))
    b = expected.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in columns), F.lit(True).alias("__inb"))
    both = a.join(b, keys, "full")
    paired = F.col("__ina") & F.col("__inb")

    def cell(c: str):
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        numeric = dict(actual.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")
        apart = F.abs(x.cast("double") - y.cast("double")) if numeric else F.lit(None).cast("double")
        same = x.eqNullSafe(y)
        within = F.coalesce(apart <= absolute + relative * F.abs(y.cast("double")), F.lit(False)) if numeric else F.lit(False)
        return F.struct(F.lit(c).alias("column_name"), same.alias("same"), within.alias("within"), apart.alias("apart"), F.coalesce(paired, F.lit(False)).alias("paired"))

    cells = both.select(F.explode(F.array(*(cell(c) for c in columns))).alias("x")).select("x.*")
    return cells.groupBy("column_name").agg(
        F.count_if(F.col("paired") & F.col("same")).alias("n_equal"),
        F.count_if(F.col("paired") & ~F.col("same")).alias("n_different"),
        F.count_if(F.col("paired") & ~F.col("same") & ~F.col("within")).alias("n_beyond_tolerance"),
        F.count_if(~F.col("paired")).alias("n_unpaired"),
        F.max(F.when(F.col("paired"), F.col("apart"))).alias("max_difference"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def row_digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the SHA-256 of its rows' values in the named columns; null and empty texts differ."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return df.withColumn("digest", F.sha2(F.concat_ws("\u001f", *(text(c) for c in columns)), 256))


def content_digest(df: DataFrame, columns: list[str], groups: list[str] = ()) -> DataFrame:
    """A digest of a table (or of each group) that doesn't depend on the order of its rows: the sum of its rows' digests' first 15 digits."""
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")
    return row_digests(df, columns).groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(number).cast("string").alias("content"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` without a row in ``right``: must be empty where a join is to be complete."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def forbidden_columns(df: DataFrame, patterns: tuple[str, ...] = (r"^[QS]\d+$", r"oracle", r"outcome")) -> list[str]:
    """Names of columns that a feature table must not have."""
    import re

    return [c for c in df.columns if any(re.search(p, c, re.I) for p in patterns)]


def merged_reports(parts: DataFrame) -> DataFrame:
    """The report of a whole table out of the reports (see ``compare_tables``) of its parts."""
    counts = ("n_equal", "n_different", "n_beyond_tolerance", "n_unpaired")
    return parts.groupBy("column_name").agg(*(F.sum(c).alias(c) for c in counts), F.max("max_difference").alias("max_difference"))


def tree_digest(df: DataFrame, columns: list[str], levels: tuple[int, ...] = (4, 2, 0)) -> DataFrame:
    """One row: ``n_rows`` and ``digest``, the SHA-256 of the table's columns and rows, whatever their order.

    Rows' digests are gathered by their first hexadecimal digits, sorted and
    hashed, and these again by fewer digits: a tree, whose lists are rows over
    16 ** 4 in size, and at last 256. Columns and types are part of the digest.
    """
    rows = row_digests(df, columns).select("digest", F.lit(1).cast("bigint").alias("n"))
    for depth in levels:
        grouped = rows.groupBy(F.substring("digest", 1, depth).alias("__p") if depth else F.lit("").alias("__p"))
        rows = grouped.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("__d"), F.sum("n").alias("n"))
        rows = rows.select(F.concat("__p", F.col("__d")).alias("digest") if depth else F.col("__d").alias("digest"), "n")
    schema = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in columns)
    return rows.select(F.col("n").alias("n_rows"), F.sha2(F.concat(F.lit(schema + "|"), F.col("digest")), 256).alias("digest"))


def differing_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: how many rows only the first and only the second table has, repeated rows counted. Both are 0 for equal tables."""
    columns = first.columns
    marked = first.withColumn("__m", F.lit(1)).unionByName(second.select(*columns).withColumn("__m", F.lit(-1)))
    net = marked.groupBy(*columns).agg(F.sum("__m").alias("__n")).where("__n <> 0")
    return net.agg(F.coalesce(F.sum(F.greatest("__n", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("only_second"))
