"""More of the study's operators over the event stream, with their SQL: phases, windows before labels, hierarchies, further inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import episodes, external, inference, masks, personal, phases
from gapline.plans import study_queries as base
from gapline.plans.study_queries import CELLS, D, EV, KEYS, MASKS, ROOT, TOTALS, _day_means, _deltas, _features, _hash, _masks, _pair, _participant_deltas, places, readings, six, text_day
from gapline.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL, under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- phases -----------------------------------------------------------------------------------------------------------

_PB = "pb as (select subject_id, day, floor(minute / 30)::int as phase_bin, count(value)::bigint as units, sum(value) as numerator, avg(value) as bin_mean, least(count(value) / 2.0, 1)::double as support from ev where value is not null group by all)"


def _bins(spark: SparkSession, folder: str) -> DataFrame:
    return phases.phase_bins(readings(spark, folder), KEYS, "minute", "value", 2)


@query(f"with {EV}, {_PB} select subject_id, {D}, phase_bin, units, round(numerator, 6) as numerator, round(bin_mean, 9) as bin_mean, support from pb")
def op108_phase_bins(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(places(six(_bins(spark, folder), "numerator"), 9, "bin_mean"))


@query(f"with {EV}, {TOTALS} select subject_id, {D}, round(s, 6) as day_sum, round(s / n, 9) as day_mean from tot")
def op111_daily_from_bins(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(places(six(phases.daily_from_bins(_bins(spark, folder), KEYS), "day_sum"), 9, "day_mean"))


_TEMPLATE = f"{_PB}, pm as (select subject_id, phase_bin, median(bin_mean) as personal, count(*)::bigint as n from pb group by all), om as (select a.subject_id, a.phase_bin, median(b.personal) as population from pm a join pm b on b.phase_bin = a.phase_bin and b.subject_id <> a.subject_id group by 1, 2)"


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    own = _bins(spark, folder).groupBy("subject_id", "phase_bin").agg(F.median("bin_mean").alias("personal"), F.count(F.lit(1)).alias("n"))
    return phases.others_median(own, ["phase_bin"], "subject_id", "personal", "population")


@query(f"with {EV}, {_TEMPLATE} select pm.subject_id, pm.phase_bin, round(personal, 9) as personal, round(population, 9) as population from pm left join om using (subject_id, phase_bin)")
def op174_others_median(spark: SparkSession, folder: str) -> DataFrame:
    return places(_templates(spark, folder).select("subject_id", "phase_bin", "personal", "population"), 9, "personal", "population")


@query(f"with {EV}, {_TEMPLATE} select pm.subject_id, pm.phase_bin, round(coalesce(n / (n + 7.0) * personal + (1 - n / (n + 7.0)) * population, personal), 6) as template from pm left join om using (subject_id, phase_bin)")
def op176_phase_templates(spark: SparkSession, folder: str) -> DataFrame:
    t = phases.shrunk_template(F.col("personal"), F.col("population"), F.col("n"))
    return six(_templates(spark, folder).select("subject_id", "phase_bin", t.alias("template")), "template")


_CUT = "m0 as (select subject_id, day, mask_start, mask_end from mask where scenario = 'contiguous_20pct' and draw = 0), mb as (select *, unnest(range(mask_start // 30, (mask_end - 1) // 30 + 1))::int as phase_bin from m0), mf as (select subject_id, day, phase_bin, greatest(least(mask_end, (phase_bin + 1) * 30) - greatest(mask_start, phase_bin * 30), 0) / 30.0 as f from mb)"


@query(f"with {EV}, {CELLS}, {MASKS}, {_CUT} select subject_id, {D}, phase_bin, round(f, 6)::double as masked_fraction from mf")
def op112_masked_fractions(spark: SparkSession, folder: str) -> DataFrame:
    m = _masks(spark, folder, {"contiguous_20pct": (0.2, None)}).where("draw = 0")
    bins = m.withColumn("phase_bin", F.explode(F.sequence(F.floor(F.col("mask_start") / 30).cast("int"), F.floor((F.col("mask_end") - 1) / 30).cast("int"))))
    return text_day(six(bins.select(*KEYS, "phase_bin", phases.masked_fraction(F.col("mask_start"), F.col("mask_end"), F.col("phase_bin")).alias("masked_fraction")), "masked_fraction"))


@query(f"""with {EV}, {CELLS}, {MASKS}, {_CUT}, {_PB}, tp as (select subject_id, phase_bin, avg(numerator) as template from pb group by all),
 ob as (select m.subject_id, m.day, sum(case when e.minute < m.mask_start or e.minute >= m.mask_end then e.value end) as observed_sum from m0 m join ev e using (subject_id, day) group by 1, 2),
 ad as (select subject_id, day, case when count(template) = count(*) then sum(template * f) end as added from mf left join tp using (subject_id, phase_bin) group by 1, 2)
 select subject_id, {D}, round(observed_sum, 6) as observed_sum, round(added, 6) as added, round(observed_sum + added, 6) as repaired_sum from ob join ad using (subject_id, day)""")
def op184_additive_repair(spark: SparkSession, folder: str) -> DataFrame:
    m = _masks(spark, folder, {"contiguous_20pct": (0.2, None)}).where("draw = 0").select(*KEYS, "mask_start", "mask_end")
    outside = (F.col("minute") < F.col("mask_start")) | (F.col("minute") >= F.col("mask_end"))
    observed = readings(spark, folder).join(m, KEYS).groupBy(*KEYS).agg(F.sum(F.when(outside, F.col("value"))).alias("observed_sum"))
    template = _bins(spark, folder).groupBy("subject_id", "phase_bin").agg(F.avg("numerator").alias("template"))
    # The template is the participant's, the same for each of its days.
    days = m.select(*KEYS).distinct().join(template, "subject_id")
    return text_day(six(phases.additive_repair(observed, m, days, KEYS), "observed_sum", "added", "repaired_sum"))


@query(f"with {EV}, {_PB} select subject_id, {D}, round(pow(count(*) / 48.0 * least(sum(units) / 40.0, 1) * exp(-coalesce(stddev_pop(bin_mean), 0) / 30.0) * (count(case when phase_bin >= 36 then 1 end) / 12.0), 0.25), 6) as reliability from pb group by subject_id, day")
def op183_repair_reliability(spark: SparkSession, folder: str) -> DataFrame:
    b = _bins(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"), F.sum("units").alias("u"), F.coalesce(F.stddev_pop("bin_mean"), F.lit(0.0)).alias("sd"), F.count_if(F.col("phase_bin") >= 36).alias("late"))
    r = phases.repair_reliability(F.col("k") / 48, F.col("u"), F.col("sd"), F.lit(30.0), F.col("late") / 12, 40.0)
    return text_day(six(b.select(*KEYS, r.alias("reliability")), "reliability"))


# --- windows, anchors, masks of records ---------------------------------------------------------------------------------


@query(f"with {EV}, s as (select *, epoch_us(ts) // 1000000 as sec from ev), w as (select event_id, event_type, count(value) over x as n, avg(value) over x as m from s window x as (partition by subject_id order by sec range between 3600 preceding and 20 preceding)) select event_id, n::bigint as window_n, round(m, 9) as window_mean from w where event_type = 'purchase'")
def op062_window_before_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = readings(spark, folder).withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    out = external.before_each(rows, "subject_id", "sec", "value", 3600, 20).where("event_type = 'purchase'")
    return places(out.select("event_id", "window_n", "window_mean"), 9, "window_mean")


@query(f"with {EV} select subject_id, {D}, count(value)::bigint as n, round(avg(value), 9) as mean, round(stddev_pop(value), 6) as sd, round(median(value), 6) as median, round(quantile_cont(value, 0.9), 6) as p90 from ev group by subject_id, day")
def op093_window_features(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(places(six(external.window_features(readings(spark, folder), KEYS, "value"), "sd", "median", "p90"), 9, "mean"))


@query(f"with {EV}, r as (select *, row_number() over (partition by subject_id, day order by ts, event_id) as r from ev) select subject_id, {D}, event_id from r where r = 1")
def op136_earliest_a_day(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(external.earliest_a_day(readings(spark, folder), KEYS, "ts", "event_id").select(*KEYS, "event_id"))


@query(f"""with recursive {EV}, h as (select subject_id, epoch_us(ts) // 3600000000 as h, min(epoch_us(ts) // 1000000) as s from ev group by 1, 2), a as (select subject_id, min(s) as anchor from h group by 1 union all select a.subject_id, (select min(s) from h where h.subject_id = a.subject_id and h.s >= a.anchor + 7200) from a where a.anchor is not null)
 select subject_id, anchor::bigint as anchor from a where anchor is not null""")
def op135_spaced_anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = readings(spark, folder).withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return external.spaced_anchors(rows, "subject_id", "sec", 7200)


@query(f"""with {EV}, i as (select *, row_number() over (partition by subject_id, day order by minute, event_id) - 1 as i, count(*) over (partition by subject_id, day) as n, row_number() over (partition by subject_id, day order by {_hash("sha256('gapline|' || event_id::varchar)")}, event_id) as r from ev),
 k as (select *, floor(n * 0.2 + 1e-9)::bigint as k, {_hash("sha256('gapline|' || subject_id || '|' || strftime(day, '%Y-%m-%d'))")} % (n - floor(n * 0.2 + 1e-9)::bigint + 1) as s from i) select event_id, i >= s and i < s + k as in_block, r <= k as in_scatter from k""")
def op160_index_masks(spark: SparkSession, folder: str) -> DataFrame:
    return external.index_masks(readings(spark, folder), KEYS, "minute", "event_id", ROOT).select("event_id", "in_block", "in_scatter")


@query(f"with {EV}, i as (select *, row_number() over (partition by subject_id, day order by minute, event_id) - 1 as i from ev) select event_id from i where i % 3 = 0")
def op161_coarser_cadence(spark: SparkSession, folder: str) -> DataFrame:
    return external.thinned(readings(spark, folder), KEYS, "minute", "event_id", 3).select("event_id")


@query(f"with {EV}, i as (select *, row_number() over (partition by subject_id, day order by sha256('gapline|' || event_id::varchar), event_id) as r, count(*) over (partition by subject_id, day) as n from ev) select event_id from i where r <= ceil(n * 0.7 - 1e-9)")
def op161_kept_share(spark: SparkSession, folder: str) -> DataFrame:
    return external.kept_share(readings(spark, folder), KEYS, "event_id", ROOT, 0.7).select("event_id")


@query(f"with {EV}, d as (select *, minute - lag(minute) over (partition by subject_id, day order by minute, event_id) as d from ev) select subject_id, {D}, count(*)::bigint as records, round(min(d), 6) as least_gap, round(median(d), 6) as median_gap, round(max(d), 6) as greatest_gap from d group by subject_id, day")
def op089_support_summary(spark: SparkSession, folder: str) -> DataFrame:
    return text_day(six(external.support_summary(readings(spark, folder), KEYS, "minute", "event_id"), "least_gap", "median_gap", "greatest_gap"))


@query(f"""with {EV}, p as (select distinct subject_id, day, floor(minute / 30)::int as slot from ev where value is not null) select a.subject_id, strftime(a.day, '%Y-%m-%d') as day, a.slot, count(b.day)::bigint as other_days, count(case when b.day < a.day then 1 end)::bigint as past_days, count(case when b.day > a.day then 1 end)::bigint as future_days,
 count(case when (isodow(b.day) >= 6) = (isodow(a.day) >= 6) then 1 end)::bigint as same_kind_days from p a left join p b on b.subject_id = a.subject_id and b.slot = a.slot and b.day <> a.day group by 1, 2, 3""")
def op065_donor_counts(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.operators import repair

    profiles = repair.day_profiles(readings(spark, folder), "subject_id", "day", "minute", "value")
    return text_day(external.donor_counts(profiles, "subject_id", "day"))


@query("select o_orderkey, case when o_orderpriority = '1-URGENT' then 1 else 0 end as o_orderpriority_1_urgent, case when o_orderpriority = '2-HIGH' then 1 else 0 end as o_orderpriority_2_high, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end as o_orderpriority_other from orders")
def op209_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    out = o.select("o_orderkey", *external.one_hot(o, "o_orderpriority", ["1-URGENT", "2-HIGH"]))
    return out.withColumnsRenamed({"o_orderpriority_1-URGENT": "o_orderpriority_1_urgent", "o_orderpriority_2-HIGH": "o_orderpriority_2_high"})


@query(f"with {EV}, d as (select distinct day from ev) select {D}, round(sin((isodow(day) - 1) * 2 * pi() / 7), 6) + 0.0 as weekday_sin, round(cos((isodow(day) - 1) * 2 * pi() / 7), 6) + 0.0 as weekday_cos, round((day - date '2024-01-01') / 30.0, 6)::double as trend from d")
def op210_calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    days = readings(spark, folder).select("day").distinct()
    out = six(days.select("day", *external.calendar_features(F.col("day"), F.datediff("day", F.lit("2024-01-01").cast("date")))), "weekday_sin", "weekday_cos", "trend")
    return text_day(out.withColumns({c: F.col(c) + 0.0 for c in ("weekday_sin", "weekday_cos")}))


# --- hierarchies and further inference ------------------------------------------------------------------------------------

_STRESSED = f"with {EV}, {CELLS}, {TOTALS}, {MASKS}, {base._HURT}, {base._TARGET}, {base._SCATTER}, {base._SCALES}, {base._STRESS}"


@query(f"{_STRESSED}, g as (select subject_id, draw, median(delta) as m from delta where delta is not null group by 1, 2), p as (select subject_id, median(m) as m from g group by 1) select count(*)::bigint as n_participants, round(median(m), 6) as effect, count(case when m > 0 then 1 end)::bigint as n_positive from p")
def op100_median_pyramid(spark: SparkSession, folder: str) -> DataFrame:
    by_draw = _deltas(spark, folder).where("delta is not null").groupBy("subject_id", "draw").agg(F.median("delta").alias("m"))
    return six(inference.participant_summary(by_draw, "subject_id", "m").withColumnRenamed("median", "effect"), "effect")


@query(f"""with {EV}, {CELLS}, {TOTALS}, {MASKS}, {base._HURT}, {base._REPLAY}, {base._SCALES}, g as (select subject_id, scenario, draw, avg(abs(retained_mean - original_mean) / standardizer) as mae, count(retained_mean) / count(*)::double as kept from played join std using (subject_id) group by 1, 2, 3), p as (select subject_id, scenario, avg(mae) as mae, avg(kept) as kept from g group by 1, 2)
 select scenario, count(*)::bigint as n_participants, round(avg(mae), 6) as mae, round(avg(kept), 6) as retention from p group by 1""")
def op096_hierarchical_reliability(spark: SparkSession, folder: str) -> DataFrame:
    ev = readings(spark, folder)
    played = masks.replay(ev, masks.deleted(ev, _masks(spark, folder), KEYS, "minute", base.MASK), KEYS, base.MASK, "event_id", "value")
    scale = personal.standardizers(_day_means(spark, folder), "subject_id", "m").select("subject_id", "standardizer")
    error = F.abs(F.col("retained_mean") - F.col("original_mean")) / F.col("standardizer")
    own = played.join(scale, "subject_id").groupBy("subject_id", "scenario", "draw").agg(F.avg(error).alias("mae"), (F.count("retained_mean") / F.count(F.lit(1))).alias("kept"))
    person = own.groupBy("subject_id", "scenario").agg(F.avg("mae").alias("mae"), F.avg("kept").alias("kept"))
    return six(person.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_participants"), F.avg("mae").alias("mae"), F.avg("kept").alias("retention")), "mae", "retention")


@query(f"{base._PAIR} select subject_id, count(*)::bigint as n, round(regr_sxx(y, x), 6) as sxx, round(regr_syy(y, x), 6) as syy, round(regr_sxy(y, x), 6) as sxy from pr group by 1")
def op225_sufficient_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.pair_sums(_pair(spark, folder), ["subject_id"], "x", "y"), "sxx", "syy", "sxy")


@query(f"""{base._PAIR}, {base._SUMS}, nn as (select *, row_number() over (order by subject_id) - 1 as i, count(*) over () as k from sm), sl as (select i as j, k, unnest(range(0, 300))::int as draw from nn), pk as (select draw, {_hash("sha256('gapline|' || draw::varchar || '|' || j::varchar)")} % k as i from sl),
 r as (select draw, sum(c) / sqrt(sum(a) * sum(b)) as r from pk join nn using (i) group by 1) select count(r)::bigint as draws, round(quantile_cont(r, 0.025), 6) as low, round(quantile_cont(r, 0.975), 6) as high from r""")
def op229_bootstrap_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.bootstrap_correlation(_pair(spark, folder), "subject_id", "x", "y", 300, ROOT), "low", "high")


@query(f"""{base._PARTS}, nn as (select *, row_number() over (order by subject_id) - 1 as i from pd), sg as (select unnest(range(0, (1 << (select count(*) from pd)::int))) as k), sums as (select k, sum(case when (k >> i::int) & 1 = 1 then -delta else delta end) as s from sg, nn group by 1)
 select (select count(*) from pd)::bigint as n_participants, round((select avg(delta) from pd), 6) as mean, round(avg(case when s >= (select sum(delta) from pd) - 1e-9 then 1.0 else 0.0 end), 6)::double as p_value from sums""")
def op241_one_sided_sign_flip(spark: SparkSession, folder: str) -> DataFrame:
    return six(inference.sign_flip(_participant_deltas(spark, folder), "delta", two_sided=False), "mean", "p_value")


@query(f"""{base._DAYS}, cd as (select subject_id, 'early' as candidate, median(m) - 49 as delta from daymean where day < date '2024-01-16' group by 1 union all select subject_id, 'late', median(m) - 51 from daymean where day >= date '2024-01-16' group by 1), nn as (select *, dense_rank() over (order by subject_id) - 1 as i from cd),
 sg as (select unnest(range(0, (1 << (select count(distinct subject_id) from cd)::int))) as k), mm as (select k, candidate, avg(case when (k >> i::int) & 1 = 1 then -delta else delta end) as m from sg, nn group by 1, 2), tp as (select k, max(m) as t from mm group by 1), ob as (select candidate, avg(delta) as mean from cd group by 1)
 select candidate, round(mean, 6) as mean, round((select avg(case when t >= mean - 1e-12 then 1.0 else 0.0 end) from tp), 6)::double as p_value from ob""")
def op242_max_sign_flip(spark: SparkSession, folder: str) -> DataFrame:
    means = _day_means(spark, folder)
    late = F.col("day") >= F.lit("2024-01-16").cast("date")
    own = means.groupBy("subject_id", F.when(late, "late").otherwise("early").alias("candidate")).agg(F.median("m").alias("md"))
    own = own.select("subject_id", "candidate", (F.col("md") - F.when(F.col("candidate") == "early", 49).otherwise(51)).alias("delta"))
    return six(inference.max_sign_flip(own, "candidate", "subject_id", "delta"), "mean", "p_value")


@query(f"{base._PAIR}, z as (select subject_id, x - avg(x) over (partition by subject_id) as a, y - avg(y) over (partition by subject_id) as b from pr) select subject_id, round(avg(case when sign(round(a, 9)) = sign(round(b, 9)) then 1.0 else 0.0 end), 6)::double as agreement from z group by 1")
def op255_sign_agreement(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("subject_id")
    z = _pair(spark, folder).select("subject_id", F.signum(F.round(F.col("x") - F.avg("x").over(w), 9)).alias("a"), F.signum(F.round(F.col("y") - F.avg("y").over(w), 9)).alias("b"))
    return six(z.groupBy("subject_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement")), "agreement")


@query(f"{base._DAYS} select subject_id, round(avg(m - 50) / (stddev_samp(m) / sqrt(count(*))), 6) as t from daymean group by 1")
def op256_studentized_mean(spark: SparkSession, folder: str) -> DataFrame:
    m = _day_means(spark, folder).groupBy("subject_id").agg((F.avg(F.col("m") - 50) / (F.stddev_samp("m") / F.sqrt(F.count("m")))).alias("t"))
    return six(m, "t")


@query(f"with {EV}, f as ({base._FEATURES}), l as (" + " union all ".join(f"select '{n}' as primitive, {n} as v from f" for n in base._NAMES) + ") select primitive, round(greatest(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 0.01), 6) as span from l group by 1")
def op268_family_scales(spark: SparkSession, folder: str) -> DataFrame:
    from gapline.operators import daily

    long = daily.long_features(_features(spark, folder), KEYS, base._NAMES)
    span = F.percentile("feature_value", F.lit(0.9)) - F.percentile("feature_value", F.lit(0.1))
    return six(long.groupBy("primitive").agg(F.greatest(span, F.lit(0.01)).alias("span")), "span")


@query()
def op232_nuisance_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    pair = _pair(spark, folder).withColumns({"trend": F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double"), "weekend": (F.weekday("day") >= 5).cast("double")})
    return six(inference.residual_correlation(pair, "subject_id", "x", "y", ["trend", "weekend"]), "r")


@query()
def op294_decoded_states(spark: SparkSession, folder: str) -> DataFrame:
    bins = _bins(spark, folder).select(*KEYS, "phase_bin", "bin_mean", "support")
    return text_day(episodes.decode(bins, "subject_id", "day", "phase_bin", ["bin_mean", "support"]))


# --- set algebra of keys --------------------------------------------------------------------------------------------------


@query("select count(*)::bigint as n_paired, (select count(*) from (select o_custkey from orders except select c_custkey from customer))::bigint as n_left_only, (select count(*) from (select c_custkey from customer except select o_custkey from orders))::bigint as n_right_only from (select distinct o_custkey from orders) join customer on c_custkey = o_custkey")
def op049_paired_keys(spark: SparkSession, folder: str) -> DataFrame:
    left = read(spark, folder, "orders").select(F.col("o_custkey").alias("k")).distinct()
    right = read(spark, folder, "customer").select(F.col("c_custkey").alias("k")).distinct()
    both = left.withColumn("a", F.lit(1)).join(right.withColumn("b", F.lit(1)), "k", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_paired"), F.count_if(F.col("b").isNull()).alias("n_left_only"), F.count_if(F.col("a").isNull()).alias("n_right_only"))


@query("select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderdate = l_shipdate)")
def op055_key_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    keys = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("l_shipdate"))
    return read(spark, folder, "lineitem").join(keys, ["l_orderkey", "l_shipdate"], "left_semi").select("l_orderkey", "l_linenumber")


@query(f"with {EV}, g as (select subject_id, event_type, day from (select distinct subject_id from ev), (select distinct event_type from ev), (select distinct day from ev)) select g.subject_id, g.event_type, strftime(g.day, '%Y-%m-%d') as day from g left join ev using (subject_id, event_type, day) where ev.event_id is null")
def op166_missing_topology(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the complete grid that have no reading. Types and days are short fixed axes, exploded for each participant."""
    ev = readings(spark, folder)
    axes = ev.agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.array_sort(F.collect_set("day")).alias("days")).first()
    if len(axes.types) > 1000 or len(axes.days) > 10_000:
        raise ValueError("an axis of the grid is too long")
    grid = ev.select("subject_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, axes.types)))).withColumn("day", F.explode(F.array(*map(F.lit, axes.days))))
    return text_day(grid.join(ev.select("subject_id", "event_type", "day").distinct(), ["subject_id", "event_type", "day"], "left_anti"))


@query("select strftime(timezone('America/New_York', timezone('UTC', ts))::date, '%Y-%m-%d') as local_day, count(*)::bigint as n from events group by 1")
def op012_local_days(spark: SparkSession, folder: str) -> DataFrame:
    days = read(spark, folder, "events").select(external.local_day(F.col("ts"), "America/New_York").alias("d"))
    return days.groupBy(F.date_format("d", "yyyy-MM-dd").alias("local_day")).agg(F.count(F.lit(1)).alias("n"))
