"""Files in and out: parquet, CSV (plain or gzip), JSON, JSON lines and Arrow, with manifests of what was written."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table out of files. ``kind``: parquet, orc, csv, json (one document a file) or jsonl.

    CSV files, also gzipped ones, have a header; their columns are texts unless a
    schema is given. Nothing is inferred from samples.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", "true").csv(path)
    if kind == "json":
        return reader.option("multiLine", "true").json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise ValueError(kind)


def scan_arrow(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """A table out of Arrow IPC files or streams, read on the executors, one file a task, batch by batch."""

    def batches(its):
        import pyarrow as pa

        for it in its:
            for path in it.column("path").to_pylist():
                with open(path, "rb") as head:
                    # The file format begins with this mark; a stream has none.
                    whole = head.read(6) == b"ARROW1"
                with pa.memory_map(path) as source:
                    if whole:
                        held = pa.ipc.open_file(source)
                        yield from map(held.get_batch, range(held.num_record_batches))
                    else:
                        yield from pa.ipc.open_stream(source)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(batches, schema)


def save(df: DataFrame, folder: str, name: str, partition_by: list[str] = ()) -> dict:
    """Write a new parquet table (an existing one is an error) and return its record for the manifest."""
    path = f"{folder}/{name}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return {"name": name, "columns": [list(t) for t in df.dtypes], "rows": df.sparkSession.read.parquet(path).count()}


def seal(folder: str, stage: str, tables: list[dict], parents: list[str] = ()) -> dict:
    """Write the stage's manifest: its tables, the SHA-256 of each of its files, and the manifests it builds on."""
    root = Path(folder)
    files = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.parquet")) if p.is_file()}
    manifest = {"stage": stage, "tables": tables, "files": files, "parents": {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in parents}}
    (root / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def broken(folder: str, _seen: set[str] | None = None) -> list[str]:
    """Files that don't match the manifest, are missing, or aren't in it, here and in all stages that this one builds on."""
    root = Path(folder)
    seen = set() if _seen is None else _seen
    seen.add(str((root / "manifest.json").resolve()))
    manifest = json.loads((root / "manifest.json").read_text())
    now = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.parquet")) if p.is_file()}
    bad = {f for f in {*now, *manifest["files"]} if now.get(f) != manifest["files"].get(f)}
    for parent, digest in manifest["parents"].items():
        path = Path(parent)
        if not path.is_file() or hashlib.sha256(path.read_bytes()).hexdigest() != digest:
            bad.add(parent)
        elif path.name == "manifest.json" and str(path.resolve()) not in seen:
            bad |= {f"{path.parent}/{f}" if not f.startswith("/") else f for f in broken(str(path.parent), seen)}
    return sorted(bad)
