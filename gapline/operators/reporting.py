"""Roll-ups and tables of reports: explicit denominators, medians of participants, pivots by scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def others_prevalence(df: DataFrame, subject: str, label: str, group: list[str], out: str) -> DataFrame:
    """``out``: the smoothed share of 1 among all other participants' rows of the group, (n1 + 1) / (n + 2): sums less the own part."""
    known = df.where(F.col(label).isNotNull() & F.col(subject).isNotNull())
    own = known.groupBy(subject, *group).agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__s"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rest = own.select(subject, *group, ((F.sum("__s").over(w) - F.col("__s") + 1) / (F.sum("__n").over(w) - F.col("__n") + 2)).alias(out))
    keys = [subject, *group]
    renamed = rest.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return known.join(renamed, on).drop(*(f"__{k}" for k in keys))


def row_scores(df: DataFrame, label: str, p: str, clip: float = 1e-6) -> DataFrame:
    """``log_loss`` and ``brier`` of each row."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - clip)), F.lit(clip))
    y = F.col(label)
    return df.withColumns({"log_loss": F.when(y == 1, -F.log(q)).otherwise(-F.log(1 - q)), "brier": (F.col(p) - y) * (F.col(p) - y)})


def score_levels(rows: DataFrame, subject: str, target: str, metrics: tuple[str, ...] = ("log_loss", "brier")) -> DataFrame:
    """Means at each level: ``level``, ``name``, ``n``, and the metrics.

    participant_target, participant (mean of its targets), target (mean of its
    participants), macro (mean of participants) and row (every row alike).
    """
    pt = rows.groupBy(subject, target).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))
    avg = lambda df, by, level, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics)).select(F.lit(level).alias("level"), name.alias("name"), "n", *metrics)
    both = pt.select(F.lit("participant_target").alias("level"), F.concat_ws("/", F.col(subject), F.col(target)).alias("name"), "n", *metrics)
    person = avg(pt, [subject], "participant", F.col(subject))
    out = both.unionByName(person).unionByName(avg(pt, [target], "target", F.col(target)))
    return out.unionByName(avg(person, [], "macro", F.lit("all"))).unionByName(avg(rows, [], "row", F.lit("all")))


def hierarchy(cells: DataFrame, by: list[str], subject: str, draw: str, error: str, draws: DataFrame) -> DataFrame:
    """Cell to participant and draw to participant to all, with every draw of every participant in the denominator.

    ``cells``: ``by``, ``subject``, ``draw``, ``error`` (null if abstained). ``draws``: ``by``, ``draw``: all
    that should be. A participant is complete if each draw has a finite error, and
    only then has a mean; ``macro_error`` needs all participants complete.
    ``retention`` is the share of finite cells of all cells.
    """
    roster = cells.select(*by, subject).distinct()
    spine = roster.join(draws.select(*by, draw).distinct(), by)
    per_draw = cells.groupBy(*by, subject, draw).agg(F.count(F.lit(1)).alias("n"), F.count(error).alias("k"), F.avg(error).alias("e"))
    full = spine.join(per_draw, [*by, subject, draw], "left")
    person = full.groupBy(*by, subject).agg(F.count(F.lit(1)).alias("n_draws"), F.count("e").alias("n_finite_draws"), F.avg("e").alias("mean"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    person = person.withColumn("complete", F.col("n_draws") == F.col("n_finite_draws"))
    every = person.groupBy(*by).agg(F.count(F.lit(1)).alias("n_participants"), F.count_if("complete").alias("n_complete"), F.avg(F.when(F.col("complete"), F.col("mean"))).alias("m"), F.avg("mean").alias("mean_error"), (F.sum("k") / F.sum("n")).alias("retention"))
    return every.withColumn("macro_error", F.when(F.col("n_participants") == F.col("n_complete"), F.col("m"))).drop("m")


def reason_histogram(df: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Of each group how often each reason occurs, as one text in order: ``reason=n|...``."""
    counts = df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.coalesce(reason, F.lit("none")), F.col("n").cast("string")))), "|").alias("reasons"))


def condition_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """What masks do to decisions. ``rows``: ``by``, ``replay_status``, ``p`` and ``p_masked`` (probabilities; null if there is none).

    Of each condition: rows, finite, abstained and unavailable ones; ``coverage`` and
    ``abstention`` of those available; ``drift`` and ``flip_rate`` (decisions at 0.5 that change) of the
    finite; ``burden``, the mean of |dp| where finite and 1 where abstained.
    """
    finite = F.col("p_masked").isNotNull() & F.col("p").isNotNull()
    gone = F.col("p").isNull()
    move = F.abs(F.col("p_masked") - F.col("p"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(finite).alias("n_finite"), F.count_if(~finite & ~gone).alias("n_abstained"), F.count_if(gone).alias("n_unavailable"), F.avg(F.when(finite, move)).alias("drift"),
        F.avg(F.when(finite, ((F.col("p") >= 0.5) != (F.col("p_masked") >= 0.5)).cast("double"))).alias("flip_rate"), F.avg(F.when(finite, move).when(~gone, 1.0)).alias("burden"),
    )
    n = F.col("n_rows") - F.col("n_unavailable")
    return out.withColumns({"coverage": F.when(n > 0, F.col("n_finite") / n), "abstention": F.when(n > 0, F.col("n_abstained") / n)})


def pivoted_medians(df: DataFrame, row: str, column: str, names: list[str], subject: str, value: str) -> DataFrame:
    """Medians over participants of their own medians, one column a name."""
    own = df.where(F.col(value).isNotNull()).groupBy(row, column, subject).agg(F.median(value).alias("__m"))
    return own.groupBy(row).pivot(column, names).agg(F.median("__m"))


def fallback_table(df: DataFrame, by: list[str], filled: str, reason: str) -> DataFrame:
    """Attempts, those filled, those that abstained with a reason, and the share filled."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("attempted"), F.count(filled).alias("imputed"), F.count(reason).alias("abstained"))
    return out.withColumn("imputed_share", F.try_divide(F.col("imputed"), F.col("attempted")))


def donor_tables(df: DataFrame, subject: str, primitive: str, donors: str, unit: str) -> DataFrame:
    """Least, median and greatest number of donors and the number of units, by participant and primitive and by primitive."""
    out = df.groupingSets([[F.col(subject), F.col(primitive)], [F.col(primitive)]], subject, primitive)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(unit).alias("n_units"), F.min(donors).alias("least"), F.median(donors).alias("median"), F.max(donors).alias("greatest"))


def support_table(daily: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of the views of each group: how many have a value, and the quartiles of coverage or density."""
    c = F.coalesce("coverage", "support_density")
    return daily.groupBy(*by).agg(F.count(F.lit(1)).alias("n_views"), F.count("value").alias("n_valued"), *(F.percentile(c, F.lit(q)).alias(f"coverage_{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.sum("n_records").alias("n_records"))


def retained_error(df: DataFrame, subject: str, risk: str, error: str, share: float = 0.7) -> DataFrame:
    """Each participant's median error over the least risky ``share`` of its rows (rounded down, one at least), and how many they are."""
    w = Window.partitionBy(subject)
    ranked = df.where(F.col(error).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(risk, error)), "__n": F.count(F.lit(1)).over(w)})
    kept = ranked.where(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share + 1e-9)))
    return kept.groupBy(subject).agg(F.count(F.lit(1)).alias("kept"), F.median(error).alias("retained_error"))


def day_candidates(rows: DataFrame, most: int = 10) -> DataFrame:
    """Every day of each participant and primitive with the reasons against it, and the ``rank`` of those selected.

    Reasons, joined by ``|`` in this order: primitive_nonfinite,
    primitive_status_not_observed, censored, availability_missing,
    availability_zero, gap_missing, gap_zero. Days without a reason are ranked by
    coverage, then by the part of the window that isn't the longest gap, then by id.
    """
    cover, whole = F.coalesce("coverage", "support_density"), 1 - F.coalesce(F.col("longest_gap_minutes"), F.lit(0.0)) / F.col("minutes")
    why = [
        ("primitive_nonfinite", F.col("value").isNull()), ("primitive_status_not_observed", F.col("status") != "observed"), ("censored", F.col("censoring") != "none"),
        ("availability_missing", cover.isNull()), ("availability_zero", F.coalesce(cover == 0, F.lit(False))), ("gap_missing", F.col("longest_gap_minutes").isNull() & F.col("coverage").isNotNull()), ("gap_zero", F.coalesce(whole <= 0, F.lit(False))),
    ]
    marked = rows.withColumns({"reasons": F.concat_ws("|", *(F.when(bad, name) for name, bad in why)), "__c": cover, "__w": whole})
    w = Window.partitionBy("subject_id", "primitive", F.col("reasons") == "").orderBy(F.col("__c").desc(), F.col("__w").desc(), "sensor_day_id", "view_id")
    ranked = marked.withColumn("__r", F.row_number().over(w))
    chosen = (F.col("reasons") == "") & (F.col("__r") <= most)
    return ranked.select("view_id", "subject_id", "sensor_day_id", "primitive", "reasons", chosen.alias("selected"), F.when(chosen, F.col("__r")).alias("rank"))


def metric_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Of each group and metric over participants: number, mean, median, least and greatest. One row a participant in ``df``."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("m")).select(*by, "m.*").where("x is not null")
    return long.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").alias("least"), F.max("x").alias("greatest"))


def delta_summary(df: DataFrame, by: list[str], subject: str, delta: str) -> DataFrame:
    """Of each contrast over participants: mean, median, positives, the least mean without one participant, the largest share of the whole, and the studentized mean.

    ``df`` has one row a participant. The studentized mean is scaled by the
    largest absolute delta first; null with fewer than two participants or without variation.
    """
    rows = df.where(F.col(delta).isNotNull())
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(delta).alias("s"), F.median(delta).alias("median"), F.count_if(F.col(delta) > 0).alias("n_positive"), F.max(F.abs(delta)).alias("top"), F.sum(F.abs(delta)).alias("whole"), F.stddev_samp(delta).alias("sd"), F.max(delta).alias("largest"))
    n, s = F.col("n"), F.col("s")
    scaled = F.when((n > 1) & (F.col("sd") > 0), (s / n / F.col("top")) / (F.col("sd") / F.col("top") / F.sqrt(n.cast("double"))))
    # Without one participant the mean is least where the largest delta is left out.
    return sums.select(*by, "n", (s / n).alias("mean"), "median", "n_positive", F.when(n > 1, (s - F.col("largest")) / (n - 1)).alias("least_without_one"), F.when(F.col("whole") > 0, F.col("top") / F.col("whole")).alias("concentration"), scaled.alias("studentized"))
