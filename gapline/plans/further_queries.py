"""Queries of perturbations, further inference and comparison, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.robust import rank_auc
from gapline.operators import diff, episodes, inference, perturbations, replays
from gapline.plans.phase_queries import PhaseParts
from gapline.plans.primitive_queries import FRAMED, coverage_sql, query as _query, rounded, values_sql
from gapline.plans.replay_queries import _P, _after
from gapline.plans.representation_queries import CONF, RepParts
from gapline.plans.report_queries import _ERR, LABELLED, SCORED, ReportParts, predictions
from gapline.operators import reporting as rp
from gapline.plans.study_queries import _PAIR, KEYS, ROOT, _hash, _pair, six
from gapline.sources.tables import each_once, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = partial(_query, into=(QUERIES, ORACLES))

_H = "('0x' || substr(sha256({0}), 1, 15))::bigint"
_KEEP = [(f"random_{s}", f"r <= ceil(n * {s} / 100.0 - 1e-9)") for s in perturbations.SHARES]
_KEEP += [(f"periodic_{s}", f"(ceil(n * {s} / 100.0 - 1e-9) >= n or (ceil(n * {s} / 100.0 - 1e-9) <= 1 and i = 0) or (ceil(n * {s} / 100.0 - 1e-9) > 1 and floor(ceil(i * (ceil(n * {s} / 100.0 - 1e-9) - 1) / greatest(n - 1, 1) - 1e-12) * (n - 1) / greatest(ceil(n * {s} / 100.0 - 1e-9) - 1, 1) + 1e-12) = i))") for s in perturbations.SHARES]
_KEEP += [(f"outage_{m // 60}h", f"not (minute >= 1440 - n_epochs * cad + {_H.format(f'''\'{ROOT}|{m}|\' || view_id::varchar''')} % (n_epochs * cad - {m} + 1) and minute < 1440 - n_epochs * cad + {_H.format(f'''\'{ROOT}|{m}|\' || view_id::varchar''')} % (n_epochs * cad - {m} + 1) + {m})") for m in perturbations.OUTAGES]
_KEEP += [("cadence_x3", "i % 3 = 0")]
PERTURBED = f"""pl as (select *, row_number() over (partition by view_id order by t, record_id) - 1 as i, row_number() over (partition by view_id order by sha256('{ROOT}|' || record_id::varchar), record_id) as r, count(*) over (partition by view_id) as n from x where ok),
 pu as ({' union all '.join(f"select *, '{name}' as perturbation from pl where {rule}" for name, rule in _KEEP)})"""
_BY = "view_id, perturbation"
_X = f"with {FRAMED}, xo as (select * from x where ok), {values_sql('xo', 'view_id')}, {coverage_sql('xo', 'view_id')}, {PERTURBED}, {_after(values_sql('pu', _BY))}, {_after(coverage_sql('pu', _BY))}"


def _framed(spark: SparkSession, folder: str) -> DataFrame:
    return PhaseParts(spark, folder).framed


@query(f"with {FRAMED}, {PERTURBED} select view_id, perturbation, count(*)::bigint as n_kept from pu group by 1, 2")
def op161_perturbations(spark: SparkSession, folder: str) -> DataFrame:
    return perturbations.perturbed(_framed(spark, folder), ROOT).groupBy("view_id", "perturbation").agg(F.count(F.lit(1)).alias("n_kept"))


@query(f"""{_X}, nm(perturbation) as (values {', '.join(f"('{n}')" for n in perturbations.NAMES)}) select c.view_id, any_value(f.subject_id) as subject_id, any_value(f.sensor_day_id) as sensor_day_id, any_value(f.primitive) as primitive, nm.perturbation, round(coalesce(any_value(c2.n_valid), 0) / any_value(c.n_valid), 6)::double as kept_share,
 round(any_value(case when c.coverage is not null then 1 - coalesce(c2.coverage, 0) / c.coverage end), 6)::double as coverage_deficit, round(any_value(case when c.coverage is not null then (coalesce(c2.longest_gap_minutes, f.n_epochs * f.cad) - c.longest_gap_minutes) / (f.n_epochs * f.cad) end), 6)::double as gap_increase, round(any_value(v.value), 6)::double as value, round(any_value(v2.value), 6)::double as perturbed_value
 from cov c join fr f using (view_id) cross join nm left join val v on v.view_id = c.view_id left join cov2 c2 on c2.view_id = c.view_id and c2.perturbation = nm.perturbation left join val2 v2 on v2.view_id = c.view_id and v2.perturbation = nm.perturbation group by c.view_id, nm.perturbation""")
def op162_deficits(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(perturbations.deficits(_framed(spark, folder), ROOT), 6, "kept_share", "coverage_deficit", "gap_increase", "value", "perturbed_value")


_SHIFT = """nm as (select *, isodow(day) as d, row_number() over (partition by subject_id, isodow(day) order by day) - 1 as i, count(*) over (partition by subject_id, isodow(day)) as n from pr), sf as (select a.*, unnest(range(0, 6))::int as shift from nm a),
 jn as (select s.shift, s.subject_id, s.x, b.y from sf s join nm b on b.subject_id = s.subject_id and b.d = s.d and b.i = (s.i + s.shift) % s.n), ss as (select shift, subject_id, regr_sxx(y, x) as a, regr_syy(y, x) as b, regr_sxy(y, x) as c from jn group by 1, 2 having count(*) >= 2)"""


@query(f"{_PAIR}, {_SHIFT} select shift, round(sum(c) / sqrt(sum(a) * sum(b)), 6) as r from ss group by 1")
def op125_weekday_shift(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.weekday_shift_null(_pair(spark, folder), "subject_id", "day", "x", "y", 5), "r")


_FAM = f"with {LABELLED}, {SCORED}, fd0 as (select sensor_file as family, subject_id, avg(log_loss_q - log_loss) as delta from rs where sensor_file is not null group by 1, 2), fd as (select * from fd0)"


def _family_deltas(spark: SparkSession, folder: str) -> DataFrame:
    rows = rp.row_scores(predictions(spark, folder).where("sensor_file is not null"), "label", "p").withColumnRenamed("log_loss", "a").drop("brier")
    return rp.row_scores(rows, "label", "q").groupBy(F.col("sensor_file").alias("family"), "subject_id").agg(F.avg(F.col("log_loss") - F.col("a")).alias("delta"))


@query(f"""{_FAM}, fn as (select *, row_number() over (partition by family order by subject_id) - 1 as i, count(*) over (partition by family) as n from fd), fs as (select family, count(*)::bigint as n_participants, avg(delta) as mean, sum(delta) as s, sum(abs(delta)) as a from fd group by 1), fk as (select family, s, a, n_participants <= 16 as ex, unnest(range(0, case when n_participants <= 16 then (1 << least(n_participants, 30)::int) else 999 end)) as k from fs),
 fx as (select fk.family, fk.k, any_value(s) as s, any_value(a) as a, any_value(ex) as ex, sum(case when case when ex then (k >> least(i, 30)::int) & 1 else ('0x' || substr(sha256('gapline|' || k::varchar || '|' || subject_id), 1, 15))::bigint % 2 end = 1 then -delta else delta end) as f from fk join fn using (family) group by 1, 2),
 fp as (select family, case when any_value(ex) then sum((abs(f) >= abs(s) - 1e-9 * a)::int) / count(*) else (sum((abs(f) >= abs(s) - 1e-9 * a)::int) + 1) / (count(*) + 1) end as p_value from fx group by 1), fo as (select fs.family, n_participants, mean, p_value, row_number() over (order by p_value, fs.family, n_participants, mean) as r, count(*) over () as m from fs join fp using (family))
 select family, n_participants, round(mean, 6)::double as mean, round(p_value, 6)::double as p_value, round(max(least(1, (m - r + 1) * p_value)) over (order by r), 6)::double as adjusted from fo""")
def op239_family_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the hour foretells labels better than the sensor alone, by sensor."""
    return rounded(inference.family_inference(_family_deltas(spark, folder), "family", "subject_id", "delta"), 6, "mean", "p_value", "adjusted")


_DER = f"with dp as (select distinct subject_id from phase_views), de as (select subject_id, unnest(range(0, 40))::int as draw from dp), dr as (select *, coalesce(lead(subject_id) over w, first(subject_id) over w) as donor from de window w as (partition by draw order by sha256('{ROOT}|' || draw::varchar || '|' || subject_id), subject_id rows between unbounded preceding and unbounded following)), dn as (select * from dr where donor <> subject_id)"


@query(f"{_DER} select draw, subject_id, donor from dn")
def op243_derangements(spark: SparkSession, folder: str) -> DataFrame:
    return inference.cyclic_derangements(read(spark, folder, "phase_views"), "subject_id", 40, ROOT).select("draw", "subject_id", "donor")


@query(f"{_DER}, own as (select subject_id, stddev_pop(source_record_count::double) as e from (select distinct sensor_day_id, subject_id, source_record_count from calendar_days) group by 1), sc as (select draw, count(*)::bigint as n, avg(b.e - a.e) as g from dn join own a on a.subject_id = dn.subject_id join own b on b.subject_id = dn.donor group by 1) select draw, n, round(g, 6)::double + 0.0 as mean_gain, g <= 1e-12 as as_good from sc".replace("round(g, 6)::double + 0.0", "case when abs(g) < 5e-7 then 0.0 else round(g, 6)::double end").replace("g <= 1e-12", "g <= 1e-9"))
def op244_derangement_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The spread of a participant's days against that of a deranged donor."""
    days = each_once(read(spark, folder, "calendar_days"), ["sensor_day_id", "subject_id", "source_record_count"])
    own = days.groupBy("subject_id").agg(F.stddev_pop(F.col("source_record_count").cast("double")).alias("e"))
    out = inference.derangement_scores(inference.cyclic_derangements(read(spark, folder, "phase_views"), "subject_id", 40, ROOT), own, "subject_id", "e")
    small = F.abs("mean_gain") < 5e-7
    return out.select("draw", "n", F.when(small, 0.0).otherwise(F.round("mean_gain", 6)).alias("mean_gain"), (F.col("mean_gain") <= 1e-9).alias("as_good"))


_VARIANTS = ("confidence", "coverage_only", "value_only")


@query(f"{_ERR}, {CONF}, cla as (select er.seed, (coalesce(er.error, 9) <= 0.5)::int as ok, v.name, v.c from er join cq using (view_id), lateral (values ('confidence', cq.confidence), ('coverage_only', cq.coverage_only), ('value_only', cq.value_only)) v(name, c)), rka as (select *, rank() over (partition by name order by c) + (count(*) over (partition by name, c) - 1) / 2.0 as r from cla) select name as variant, round(((sum(case when ok = 1 then r end) - count(case when ok = 1 then 1 end) * (count(case when ok = 1 then 1 end) + 1) / 2.0) / nullif(count(case when ok = 1 then 1 end) * count(case when ok = 0 then 1 end), 0)), 6)::double as auc from rka group by 1")
def op263_confidence_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """How well each variant of confidence tells small errors (at most half a scale) from large or missing ones."""
    p = ReportParts(spark, folder)
    both = p.errors.join(p.rows_.select("view_id", *_VARIANTS), "view_id").withColumn("ok", (F.coalesce("error", F.lit(9.0)) <= 0.5).cast("int"))
    long = both.select("ok", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("c")) for v in _VARIANTS))).alias("x")).select("ok", "x.*")
    return rounded(rank_auc(long, ["variant"], "ok", "c"), 6, "auc")


@query(f"{_P} select 0::bigint as only_first, 0::bigint as only_second from (select 1) where (select count(*) from played) >= 0")
def op150_geometry_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """A geometry made twice, from tables staged apart: no row may differ."""
    parts = [PhaseParts(spark, folder) for _ in range(2)]
    first, second = (replays.mask_geometry(p.framed, p.masks, p.gone) for p in parts)
    return diff.differing_rows(first, second)


_PRICES = "g as (select o_orderkey, o_totalprice as a, o_totalprice + case when o_orderkey % 97 = 0 then 1e-9 when o_orderkey % 101 = 0 then 5.0 else 0 end as b from orders)"


@query(f"with {_PRICES} select 'price' as column_name, count(case when a = b then 1 end)::bigint as n_equal, count(case when a <> b then 1 end)::bigint as n_different, count(case when abs(a - b) > 1e-6 then 1 end)::bigint as n_beyond_tolerance, 0::bigint as n_unpaired, round(max(abs(a - b)), 6)::double as max_difference from g")
def op307_merged_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of four parts of two tables, merged into one."""
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    key = F.col("o_orderkey")
    other = orders.withColumn("price", F.col("price") + F.when(key % 97 == 0, 1e-9).when(key % 101 == 0, 5.0).otherwise(0.0))
    parts = None
    for i in range(4):
        got = diff.compare_tables(orders.where(key % 4 == i), other.where(key % 4 == i), ["o_orderkey"], ["price"], absolute=1e-6)
        parts = got if parts is None else parts.unionByName(got)
    return rounded(diff.merged_reports(parts), 6, "max_difference")


_ROW = "sha256('=' || event_id::varchar || chr(31) || '=' || event_type)"


@query(f"with a as (select {_ROW} as d from events), b as (select substr(d, 1, 4) as p, sha256(string_agg(d, '' order by d)) as h, count(*) as n from a group by 1), c as (select substr(p || h, 1, 2) as p, sha256(string_agg(p || h, '' order by p || h)) as h, sum(n) as n from b group by 1), e as (select sha256(string_agg(p || h, '' order by p || h)) as h, sum(n) as n from c) select n::bigint as n_rows, sha256('event_id:bigint,event_type:string|' || h) as digest from e")
def op314_tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    return diff.tree_digest(read(spark, folder, "events"), ["event_id", "event_type"])


_N = "('0x' || substr(sha256({0}), 1, 15))::bigint"


@query(f"""with d as (select distinct subject_id, sensor_day_id from phase_views), k(kind, n) as (values ('contiguous_20pct', 10), ('outage_1h', 2)), e as (select *, unnest(range(0, 4))::int as draw from d, k), h as (select *, kind || '|' || draw::varchar || '|' || subject_id || '|' || sensor_day_id::varchar as name from e)
 select subject_id, sensor_day_id, kind, draw, case when kind = 'outage_1h' then ({_N.format("'" + ROOT + "|domain|' || name")} % 6)::int end as domain, ({_N.format("'" + ROOT + "|' || name")} % (48 - n + 1))::int as first_bin, ({_N.format("'" + ROOT + "|' || name")} % (48 - n + 1) + n - 1)::int as last_bin from h""")
def op163_induced_masks(spark: SparkSession, folder: str) -> DataFrame:
    return episodes.induced_masks(read(spark, folder, "phase_views"), ["subject_id", "sensor_day_id"], ROOT)
