"""Implausible readings: impossible values, sudden excursions and stuck sensors.

Excursions are judged against what the source (a participant's sensor) normally
delivers: residuals from the hour's median get tail cutoffs at a fixed risk from
a peaks-over-threshold fit, as do the jumps between neighbouring readings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize


@dataclass(frozen=True)
class SensorRule:
    """What a sensor can deliver. ``flag``: only 0 or 1. ``log``: compared as signed log(1 + x)."""

    prefix: str
    flag: bool = False
    low: float | None = None
    high: float | None = None
    log: bool = True
    jump: float = 1.0


#: Physical limits of the sensors, by the start of sensor_file.
RULES = (
    SensorRule("mScreenStatus", flag=True),
    SensorRule("mActivity", flag=True),
    SensorRule("mACStatus", flag=True),
    SensorRule("wPedo", low=0.0),
    SensorRule("mUsageStats", low=0.0),
    SensorRule("mLight", low=0.0),
    SensorRule("wLight", low=0.0),
    SensorRule("wHr", low=20.0, high=250.0, log=False, jump=10.0),
)


@dataclass(frozen=True)
class SpikeSettings:
    """``risk``: chance that a normal reading passes a cutoff. ``tail``: share of readings over the threshold of the fit.

    ``margin``: how far a cutoff lies at least beyond the last quantile of the fit, in the sensor's least jumps.
    """

    risk: float = 3e-5
    margin: float = 0.5
    tail: float = 0.05
    shape_low: float = -2.0
    shape_high: float = 0.2
    jump_factor: float = 2.0
    stuck_readings: int = 6
    pool_weight: float = 500.0
    hour_least: int = 20
    shard_hours: int = 2


def _by_rule(sensor: Column, value, default, rules=RULES) -> Column:
    out = F.lit(default)
    for r in rules:
        out = F.when(sensor.startswith(r.prefix), F.lit(value(r))).otherwise(out)
    return out


def impossible_value(sensor: Column, v: Column, rules=RULES) -> Column:
    """Whether a value that isn't missing can't be true for its quantity."""
    bad = F.abs(v) == float("inf")
    for r in rules:
        own = ~v.isin(0.0, 1.0) if r.flag else (F.abs(v) == float("inf")) | F.coalesce(v < r.low, F.lit(False)) | (F.coalesce(v > r.high, F.lit(False)) if r.high is not None else F.lit(False))
        bad = F.when(sensor.startswith(r.prefix), own).otherwise(bad)
    return bad


def in_sequence(readings: DataFrame, settings: SpikeSettings) -> DataFrame:
    """Each reading with the two before and after it in its view, and the length of its run of equal values.

    ``readings`` has ``view_id``, ``t``, ``record_id``, ``v`` and ``y``. Views are cut
    into time shards; the first and last two readings of a shard and its outer
    runs are carried across, so that a view of any size is spread over its shards.
    """
    width = settings.shard_hours * 3_600_000_000
    own = readings.withColumn("shard", F.floor(F.col("t") / width))
    w = Window.partitionBy("view_id", "shard").orderBy("t", "record_id")
    whole = Window.partitionBy("view_id", "shard")
    local = (
        own.withColumns(
            {
                "p1": F.lag("y").over(w), "p2": F.lag("y", 2).over(w), "n1": F.lead("y").over(w), "n2": F.lead("y", 2).over(w),
                "rn": F.row_number().over(w), "size": F.count(F.lit(1)).over(whole),
                "fresh": F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1),
            }
        )
        .withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy("view_id", "shard", "run")))
    )
    edge = (
        local.where("rn <= 2 or rn > size - 2")
        .groupBy("view_id", "shard")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "y", "v", "run", "run_length"))).alias("e"), F.max("size").alias("size"))
        .withColumns({"head": F.slice("e.y", 1, 2), "tail": F.slice("e.y", F.greatest(F.size("e") - 1, F.lit(1)), F.lit(2)), "a": F.col("e")[0], "z": F.element_at("e", -1)})
    )
    by_view = Window.partitionBy("view_id").orderBy("shard")
    none = F.array().cast("array<double>")
    side = lambda name, k, fn: F.coalesce(fn(name, k).over(by_view), none)
    before = F.concat(side("tail", 2, F.lag), side("tail", 1, F.lag))
    around = edge.withColumns({"before": before, "after": F.concat(side("head", 1, F.lead), side("head", 2, F.lead))})
    # The outer runs of each shard, chained where the next shard goes on with the same value.
    piece = lambda r, n, s, e: F.struct(r["v"].alias("v"), n.alias("n"), F.lit(s).alias("at_start"), F.lit(e).alias("at_end"))
    one = F.col("a.run") == F.col("z.run")
    pieces = around.select(
        "view_id", "shard", "before", "after",
        F.posexplode(F.when(one, F.array(piece(F.col("a"), F.col("size"), True, True))).otherwise(F.array(piece(F.col("a"), F.col("a.run_length"), True, False), piece(F.col("z"), F.col("z.run_length"), False, True)))).alias("pos", "x"),
    )
    order = Window.partitionBy("view_id").orderBy("shard", "pos")
    last = F.lag("x").over(order)
    joined = F.coalesce(last["at_end"] & F.col("x.at_start") & (last["v"] == F.col("x.v")), F.lit(False))
    chains = pieces.withColumn("link", F.when(joined, 0).otherwise(1)).withColumn("chain", F.sum("link").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = chains.withColumn("chain_length", F.sum("x.n").over(Window.partitionBy("view_id", "chain")))
    edges = lengths.groupBy("view_id", "shard").agg(
        F.max(F.when(F.col("x.at_start"), F.col("chain_length"))).alias("head_run"),
        F.max(F.when(F.col("x.at_end"), F.col("chain_length"))).alias("tail_run"),
        F.max("before").alias("before"),
        F.max("after").alias("after"),
    )
    both = local.withColumn("last_run", F.max("run").over(whole)).join(edges, ["view_id", "shard"])
    # get() gives null outside of the array; before ends with the nearest reading, after begins with it.
    back = lambda k: F.get("before", F.size("before") - k)
    ahead = lambda k: F.get("after", F.lit(k - 1))
    left, right = F.col("rn") - 1, F.col("size") - F.col("rn")
    return both.withColumns(
        {
            "p1": F.when(left >= 1, F.col("p1")).otherwise(back(1)),
            "p2": F.when(left >= 2, F.col("p2")).when(left == 1, back(1)).otherwise(back(2)),
            "n1": F.when(right >= 1, F.col("n1")).otherwise(ahead(1)),
            "n2": F.when(right >= 2, F.col("n2")).when(right == 1, ahead(1)).otherwise(ahead(2)),
            "run_length": F.greatest("run_length", F.when(F.col("run") == 1, F.col("head_run")), F.when(F.col("run") == F.col("last_run"), F.col("tail_run"))),
        }
    ).drop("shard", "rn", "size", "fresh", "run", "last_run", "head_run", "tail_run", "before", "after")


def isolation() -> Column:
    """How far one or two readings stand apart from both neighbours: positive above, negative below, else 0."""
    y, p1, p2, n1, n2 = (F.col(c) for c in ("y", "p1", "p2", "n1", "n2"))
    pair_a, pair_b = n1.isNotNull(), p1.isNotNull()
    above = F.greatest(
        y - F.greatest(p1, n1),
        F.when(pair_a, F.least(y, n1) - F.greatest(p1, n2)),
        F.when(pair_b, F.least(y, p1) - F.greatest(p2, n1)),
    )
    below = F.greatest(
        F.least(p1, n1) - y,
        F.when(pair_a, F.least(p1, n2) - F.greatest(y, n1)),
        F.when(pair_b, F.least(p2, n1) - F.greatest(y, p1)),
    )
    return F.when(above > 0, above).when(below > 0, -below).otherwise(0.0)


def _tail_points(hist: DataFrame, by: list[str], at: str, tail: float, name: str) -> DataFrame:
    """Threshold and two exceedance quantiles of a histogram's tail, in bins."""
    w = Window.partitionBy(*by).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0)
    far = hist.groupBy(*by, at).agg(F.sum("n").alias("n")).withColumn("beyond", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    point = lambda p: F.max(F.when(F.col("beyond") >= F.greatest(F.col("all") * p, F.lit(1)), F.col(at)))
    return far.groupBy(*by).agg(F.max("all").alias(f"{name}_n"), point(tail).alias(f"{name}_u"), point(tail / 2).alias(f"{name}_a"), point(tail / 4).alias(f"{name}_b"))


def _cutoff(excess_half: Column, excess_quarter: Column, s: SpikeSettings) -> Column:
    """How far over the threshold the fixed risk lies, by a generalized Pareto fit to two exceedance quantiles.

    With median m and upper quartile q of the exceedances the shape is
    log2(q / m - 1) and the scale m * shape / (2 ** shape - 1). Two quantiles, not
    moments, as the largest exceedances may be the very errors sought.
    """
    shape = F.least(F.greatest(F.log2(F.greatest(excess_quarter / excess_half - 1, F.lit(1e-3))), F.lit(s.shape_low)), F.lit(s.shape_high))
    shape = F.when(F.abs(shape) < 0.01, F.lit(0.01)).otherwise(shape)
    scale = excess_half * shape / (F.pow(F.lit(2.0), shape) - 1)
    return scale / shape * (F.pow(F.lit(s.risk / s.tail), -shape) - 1)


def source_cutoffs(readings: DataFrame, settings: SpikeSettings) -> DataFrame:
    """One row a source: medians by hour, and cutoffs of residuals (up, down) and jumps, in units of y.

    ``readings`` has ``subject_id``, ``sensor_file``, ``hour``, ``y``, ``jump``,
    ``bin`` and ``least`` (the sensor's least jump). They are counted in bins first, so nothing larger than a source's
    histogram is brought together. Fits of sources with few readings lean on the
    mean of their sensor.
    """
    by = ["subject_id", "sensor_file"]
    hist = materialize(
        readings.groupBy(*by, "hour", "bin", "least", F.floor(F.col("y") / F.col("bin")).cast("int").alias("yb"), F.floor(F.abs("jump") / F.col("bin")).cast("int").alias("jb")).agg(F.count(F.lit(1)).alias("n")),
        "histogram",
    )

    def median(keys: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("yb")
        counts = hist.groupBy(*keys, "yb").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        return counts.where("2 * upto >= all").groupBy(*keys).agg(F.min("yb").alias(name), F.max("all").alias(f"{name}_n"))

    hourly, overall = median([*by, "hour"], "hour_median"), median(by, "median")
    seasonal = F.when(F.col("hour_median_n") >= settings.hour_least, F.col("hour_median")).otherwise(F.col("median"))
    # The season may widen what is normal but not narrow it: a quiet hour's reading is also compared with the whole day's median.
    usual = hourly.join(overall, by).select(*by, "hour", F.greatest(seasonal, "median").alias("upper"), F.least(seasonal, "median").alias("lower"))
    residual = (
        hist.groupBy(*by, "hour", "bin", "yb").agg(F.sum("n").alias("n")).join(usual, [*by, "hour"])
        .withColumns({"above": F.greatest(F.col("yb") - F.col("upper"), F.lit(0)), "below": F.greatest(F.col("lower") - F.col("yb"), F.lit(0))})
    )
    points = (
        _tail_points(residual, by, "above", settings.tail, "up")
        .join(_tail_points(residual, by, "below", settings.tail, "down"), by)
        .join(_tail_points(hist, by, "jb", settings.tail, "jump"), by)
        .join(hist.groupBy(*by).agg(F.max("bin").alias("bin"), F.max("least").alias("least")), by)
        .join(usual.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("hour", F.struct("upper", "lower")))).alias("usual")), by)
    )
    own = {f"{name}_x{part}": F.col(f"{name}_{part}") - F.col(f"{name}_u") + 0.5 for name in ("up", "down", "jump") for part in ("a", "b")}
    points = materialize(points.withColumns(own), "points")
    # A sensor's medians are merged from parts: its sources, however many, don't meet in one task.
    pools = points.groupBy("sensor_file").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"{c}_pool") for c in own))
    out = join_bounded(points, pools, ["sensor_file"])
    n, k = F.col("up_n"), settings.pool_weight
    out = out.withColumns({c: (F.col(c) * n + F.col(f"{c}_pool") * k) / (n + k) for c in own})
    for name in ("up", "down", "jump"):
        fitted = F.col(f"{name}_u") + _cutoff(F.col(f"{name}_xa"), F.col(f"{name}_xb"), settings)
        out = out.withColumn(f"{name}_cut", F.greatest(fitted, F.col(f"{name}_u") + F.col(f"{name}_xb") + settings.margin * F.col("least") / F.col("bin")))
    scaled = {f"{n}_{p}": F.col(f"{n}_{p}") * F.col("bin") for n in ("up", "down", "jump") for p in ("u", "cut")}
    return out.withColumns(scaled).select(*by, "usual", F.col("bin").alias("unit"), *scaled)


def implausible_readings(records: DataFrame, settings: SpikeSettings = SpikeSettings(), rules=RULES) -> DataFrame:
    """The records whose value or validity can't have been read, with the reasons.

    ``records`` has ``record_id, view_id, subject_id, sensor_file,
    effective_timestamp, raw_value, raw_validity`` and any other columns. Result:
    ``record_id`` and four booleans, at least one true: ``impossible_value``
    (flags other than 0 or 1, values outside of the sensor's limits, infinite
    ones), ``impossible_validity`` (neither null, NaN, 0 nor 1), ``stuck`` (one of
    ``stuck_readings`` or more successive readings of a view with exactly the same
    positive value, of a sensor other than a flag) and ``excursion``: one or two
    readings that stand apart from both neighbours by the sensor's least jump,
    and lie beyond the source's residual cutoff; or that jump beyond twice the
    source's jump cutoff, out of its inner 90 percent. At the end of a view one
    neighbour decides. Missing values (null or NaN) are neither flagged nor
    neighbours, and impossible values are no neighbours. Readings at one instant are ordered by record_id. Records without
    view, time or source are judged by the first two rules only. Rows delivered
    twice count once. An empty table gives an empty result.
    """
    sensor = F.col("sensor_file")
    t = F.unix_micros(F.col("effective_timestamp").cast("timestamp"))
    rows = records.select("record_id", "view_id", "subject_id", "sensor_file", t.alias("t"), F.col("raw_value").cast("double").alias("v"), F.col("raw_validity").cast("double").alias("validity"))
    there = F.col("v").isNotNull() & ~F.isnan("v")
    impossible = F.coalesce(there & impossible_value(sensor, F.col("v"), rules), F.lit(False))
    invalid = F.coalesce(~F.isnan("validity") & ~F.col("validity").isin(0.0, 1.0), F.lit(False))
    no = F.lit(False)
    by_rule = rows.where(impossible | invalid).select("record_id", impossible.alias("impossible_value"), invalid.alias("impossible_validity"), no.alias("stuck"), no.alias("excursion"))

    is_flag = _by_rule(sensor, lambda r: r.flag, False, rules)
    y = F.when(_by_rule(sensor, lambda r: r.log, True, rules), F.signum("v") * F.log1p(F.abs("v"))).otherwise(F.col("v"))
    measured = (
        rows.where(there & ~is_flag & ~impossible & F.col("view_id").isNotNull() & F.col("t").isNotNull() & F.col("subject_id").isNotNull() & sensor.isNotNull())
        .select("record_id", "view_id", "subject_id", "sensor_file", "t", "v")
        .distinct()
        .withColumn("y", y)
    )
    judged = materialize(
        in_sequence(measured, settings).select(
            "record_id", "subject_id", "sensor_file", F.pmod(F.floor(F.col("t") / 3_600_000_000), F.lit(24)).cast("int").alias("hour"), "y",
            isolation().alias("jump"),
            ((F.col("run_length") >= settings.stuck_readings) & (F.col("v") > 0)).alias("stuck"),
            F.when(_by_rule(sensor, lambda r: r.log, True, rules), 0.05).otherwise(0.5).alias("bin"),
            _by_rule(sensor, lambda r: r.jump, 1.0, rules).alias("least"),
        ),
        "judged",
    )
    cutoffs = source_cutoffs(judged.where("not stuck"), settings)
    apart = judged.where(F.abs("jump") >= F.col("least"))
    known = join_bounded(apart, materialize(cutoffs, "cutoffs"), ["subject_id", "sensor_file"])
    season = F.col("usual")[F.col("hour")]
    above = F.col("y") - (season["upper"] + 0.5) * F.col("unit")
    below = (season["lower"] + 0.5) * F.col("unit") - F.col("y")
    strong = F.abs("jump") >= F.greatest("jump_cut", "least") * settings.jump_factor
    high = (F.col("jump") > 0) & ((above > F.col("up_cut")) | (strong & (above > F.col("up_u"))))
    low = (F.col("jump") < 0) & ((below > F.col("down_cut")) | (strong & (below > F.col("down_u"))))
    jumped = known.where(high | low).select("record_id", no.alias("impossible_value"), no.alias("impossible_validity"), no.alias("stuck"), F.lit(True).alias("excursion"))
    stuck = judged.where("stuck").select("record_id", no.alias("impossible_value"), no.alias("impossible_validity"), "stuck", no.alias("excursion"))
    flags = ("impossible_value", "impossible_validity", "stuck", "excursion")
    return by_rule.unionByName(jumped).unionByName(stuck).groupBy("record_id").agg(*(F.bool_or(c).alias(c) for c in flags))
