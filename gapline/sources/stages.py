"""Stages of a run as folders: tables behind a manifest, contracts of labels, and files for others."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.sources.files import broken, scan


def read_stage(spark: SparkSession, folder: str, name: str, check: bool = True) -> DataFrame:
    """A table of a sealed stage. Its columns must be those of the manifest; with ``check`` the stage's files must match it too."""
    manifest = json.loads((Path(folder) / "manifest.json").read_text())
    known = {t["name"]: t for t in manifest["tables"]}
    if name not in known:
        raise KeyError(f"{name} isn't in the manifest of {folder}")
    if check and (bad := broken(folder)):
        raise ValueError(f"files don't match the manifest: {bad}")
    out = spark.read.parquet(f"{folder}/{name}")
    if [list(t) for t in out.dtypes] != known[name]["columns"]:
        raise ValueError(f"{name} has other columns than its manifest")
    return out


def table_metadata(spark: SparkSession, path: str, kind: str) -> dict:
    """Rows and columns of a table, of parquet from footers, of Arrow files from their blocks, without reading its data."""
    if kind == "arrow":
        import pyarrow as pa

        with pa.memory_map(path) as source:
            held = pa.ipc.open_file(source)
            return {"rows": sum(held.get_batch(i).num_rows for i in range(held.num_record_batches)), "columns": [[f.name, str(f.type)] for f in held.schema]}
    df = scan(spark, path, kind)
    return {"rows": df.count(), "columns": [list(t) for t in df.dtypes]}


def write_table(df: DataFrame, path: str) -> str:
    """Write a new table as parquet; columns that parquet can't hold as they are (void) become texts. The kind is returned."""
    fixed = df.select(*(F.col(c).cast("string").alias(c) if t == "void" else F.col(c) for c, t in df.dtypes))
    fixed.write.mode("errorifexists").parquet(path)
    return "parquet"


def mixed_value(df: DataFrame, number: str, flag: str, out: str = "observed") -> DataFrame:
    """A decision that is a number in one row and a flag in another, as one column with both parts: no type is lost."""
    return df.withColumn(out, F.struct(F.col(number).cast("double").alias("number"), F.col(flag).cast("boolean").alias("flag"))).drop(number, flag)


def load_labels(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Labels of days out of a CSV file: ``subject_id``, ``lifelog_date``, ``sleep_date`` and 0/1 columns.

    A broken row is an error that says which rule it breaks: dates that are none
    or not one day apart, labels other than 0 and 1 or none, repeated days.
    """
    rows = scan(spark, path, "csv").select("subject_id", F.col("lifelog_date").try_cast("date").alias("lifelog_date"), F.col("sleep_date").try_cast("date").alias("sleep_date"), *(F.col(c).try_cast("int").alias(c) for c in labels))
    wrong = F.array_compact(F.array(
        F.when(F.col("subject_id").isNull() | F.col("lifelog_date").isNull(), "key"), F.when(~F.coalesce(F.datediff("sleep_date", "lifelog_date") == 1, F.lit(False)), "sleep_date"),
        *(F.when(F.col(c).isNotNull() & ~F.col(c).isin(0, 1), c) for c in labels),
    ))
    counts = rows.select(F.explode(wrong).alias("rule")).groupBy("rule").count().collect()
    again = rows.groupBy("subject_id", "lifelog_date").count().where("count > 1").limit(1).count()
    if counts or again:
        raise ValueError(f"labels break their contract: {sorted((r[0], r[1]) for r in counts)}, repeated days: {bool(again)}")
    return rows


def write_submission(sample: DataFrame, predictions: DataFrame, keys: list[str], columns: list[str], path: str, clip: float = 1e-6) -> None:
    """Predictions for each row of ``sample``, cut to [clip, 1 - clip], as one CSV file with a header. A row without prediction, or with two, is an error."""
    both = sample.select(*keys).join(predictions.select(*keys, *columns), keys, "left")
    n, lost = sample.count(), F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1)
    found, missing = both.agg(F.count(F.lit(1)), lost).first()
    if found != n or missing:
        raise ValueError(f"{missing} rows without prediction, {found - n} too many")
    ready = both.select(*keys, *(F.greatest(F.least(F.col(c), F.lit(1 - clip)), F.lit(clip)).alias(c) for c in columns))
    ready.orderBy(*keys).coalesce(1).write.mode("errorifexists").option("header", "true").csv(path)


def fit_states(models: list[tuple[str, dict[str, list[float]]]], spark: SparkSession) -> DataFrame:
    """Fitted models as rows: ``fit``, ``payload`` (canonical JSON) and its SHA-256."""
    rows = [(name, json.dumps(state, sort_keys=True, separators=(",", ":"))) for name, state in models]
    return spark.createDataFrame(rows, "fit string, payload string").withColumn("digest", F.sha2("payload", 256))
