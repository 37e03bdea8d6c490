"""Queries of the training-data operators over the study tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.mixing import mix
from gapline.llm.nearest import nearest_in_time
from gapline.llm.packing import pack
from gapline.llm.percentiles import bounds, combine, exact_percentiles, summarize
from gapline.llm.pii import fit, with_pii
from gapline.llm.tokens import token_counts
from gapline.sources.tables import each_once, read
from gapline.staging import join_bounded, materialize

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _by_day(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", "subject_id", "primitive", "sensor_day_id", "raw_value"])
    return rows, summarize(rows, ["subject_id", "primitive", "sensor_day_id"], "raw_value")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = each_once(read(spark, folder, "phase_records"), ["record_id", "subject_id", "primitive", "raw_value"])
    return exact_percentiles(rows, ["subject_id", "primitive"], "raw_value", PERCENTILES)


def p1_combined_days(spark: SparkSession, folder: str) -> DataFrame:
    _, days = _by_day(spark, folder)
    keys = ["subject_id", "primitive"]
    return bounds(combine(days, keys), keys, PERCENTILES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest_in_time(
        read(spark, folder, "prediction_windows"), read(spark, folder, "phase_records"), ["subject_id", "sensor_file"],
        "label_time", "effective_timestamp", "window_id", "record_id", 300,
    )
    return found.select("record_id", "window_id")


#: Tokens of a container.
CAPACITY = 1024


def _sized(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each document once, with its tokens."""
    return token_counts(each_once(read(spark, folder, "documents"), ["doc_id", *columns, "text"]), "text")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder).select("doc_id", "n_tokens"), "doc_id", "n_tokens", CAPACITY)


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    held = _packed(spark, folder).groupBy("container_id").agg(F.sum("piece_length").alias("held"))
    sums = held.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    return sums.select("n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * CAPACITY)).alias("filled_share"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _sized(spark, folder, "source").withColumn("same", F.xxhash64("text")).drop("text")
    docs = materialize(docs, "sized")
    # The documents of one text share its weight.
    copies = docs.groupBy("source", "same").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    weighed = join_bounded(docs, copies, ["source", "same"], "left").withColumn("weight", 1.0 / F.coalesce("copies", F.lit(1)))
    return mix(weighed, read(spark, folder, "mix_targets"), "doc_id", "source", "n_tokens", "weight")


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every document is packed whole, once, within the capacity, and split only if longer than it."""
    sizes = materialize(_sized(spark, folder).select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")), "sizes")
    placed = materialize(pack(sizes, "doc_id", "n", CAPACITY), "placed")
    docs = placed.groupBy("doc_id").agg(F.sum("piece_length").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("piece_start") + F.col("piece_length")).alias("reach")).join(sizes, "doc_id", "full")
    whole = docs.agg(
        F.count("packed").alias("n_documents"), F.bool_and(F.coalesce((F.col("packed") == F.col("n")) & (F.col("reach") == F.col("n")), F.lit(False))).alias("all_whole"),
        F.bool_and(F.col("pieces") == F.greatest(F.ceil(F.col("n") / CAPACITY), F.lit(1))).alias("split_only_if_longer"),
    )
    held = placed.groupBy("container_id").agg(F.sum("piece_length").alias("held")).agg((F.max("held") <= CAPACITY).alias("within_capacity"), (F.max("container_id") + 1 == F.count(F.lit(1))).alias("without_gaps"), (F.sum("held") / F.count(F.lit(1)) > 0.9 * CAPACITY).alias("filled_nine_tenths"))
    return whole.join(held)  # one row each


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source keeps its repeats, and reaches its share, scaled to the sources that have documents, to within two of the largest documents."""
    mixture, report = _mixed(spark, folder)
    report = materialize(report, "report")
    there = report.where("available_size > 0").agg(F.sum("target_share").alias("whole"))
    sizes = mixture.agg((2 * F.max("size") / F.sum(F.col("size") * F.col("copies"))).alias("slack"))
    both = report.join(there).join(sizes)  # one row each
    goal = F.when(F.col("available_size") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    return both.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", (F.col("available_size") > 0).alias("has_documents"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - goal) <= F.col("slack")).alias("share_reached"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def _tagged(spark: SparkSession, folder: str, redacted: str | None) -> DataFrame:
    docs = materialize(each_once(read(spark, folder, "documents"), ["doc_id", "text"]), "texts")
    return with_pii(docs, "text", fit(docs, "doc_id", "text", read(spark, folder, "contact_roster")), redacted=redacted)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder, None).select("doc_id", F.explode("pii").alias("x")).select("doc_id", "x.pii_type", "x.char_start")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder, "redacted").select("doc_id", "redacted")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_combined_days, p5_found, p8_packing, p8_report, p8_invariants, p9_mixture, p9_shares, p9_invariants, p10_found, p10_redacted)}

ORACLES = {
    "p1_percentiles": f"""with recs as (select distinct record_id, subject_id, primitive, raw_value from phase_records where raw_value is not null and isfinite(raw_value)),
 ranked as (select subject_id, primitive, raw_value, row_number() over (partition by subject_id, primitive order by raw_value) as r, count(*) over (partition by subject_id, primitive) as n from recs),
 qs as (select unnest({PERCENTILES})::double as q)
 select subject_id, primitive, q, n as n_values, raw_value as percentile, 0.0::double as error_bound from ranked, qs where r = greatest(ceil(round(q * n, 6)), 1)""",
    "p1_combined_days": f"""with recs as (select distinct record_id, subject_id, primitive, sensor_day_id, raw_value as v from phase_records where raw_value is not null and isfinite(raw_value)),
 cells as (select subject_id, primitive, case when v < 0 then -floor(ln(1 + abs(v)) / ln(2) * 64)::int - 1 else floor(ln(1 + abs(v)) / ln(2) * 64)::int end as cell, count(*) as n, min(v) as low, max(v) as high from recs group by all),
 upto as (select *, sum(n) over (partition by subject_id, primitive order by cell) as upto, sum(n) over (partition by subject_id, primitive) as total from cells), qs as (select unnest({PERCENTILES})::double as q)
 select subject_id, primitive, q, total::bigint as n_values, low, high from upto, qs where greatest(ceil(round(q * total, 6)), 1) <= upto and greatest(ceil(round(q * total, 6)), 1) > upto - n""",
    "p8_invariants": "select count(distinct doc_id)::bigint as n_documents, true as all_whole, true as split_only_if_longer, true as within_capacity, true as without_gaps, true as filled_nine_tenths from documents",
    "p9_invariants": "select t.source, round(t.target_share, 6) as target_share, t.max_repeats, coalesce(d.n > 0, false) as has_documents, true as repeats_kept, true as share_reached from mix_targets t left join (select source, sum(length(text)) as n from documents group by 1) d using (source)",
    "p5_found": """with w as (select distinct window_id, subject_id, sensor_file, label_time from prediction_windows where label_time is not null and sensor_file is not null),
 r as (select distinct record_id, subject_id, sensor_file, effective_timestamp as t from phase_records),
 c as (select w.window_id, r.record_id, row_number() over (partition by w.window_id order by abs(epoch_us(r.t) - epoch_us(w.label_time)), r.t, r.record_id) as k
  from w join r on r.subject_id = w.subject_id and r.sensor_file = w.sensor_file and r.t between w.label_time - interval 300 second and w.label_time + interval 300 second)
 select record_id, window_id from c where k = 1""",
}
