"""Inference over participants: correlations, sign flips, bootstraps, shift nulls, gains on common support.

What is enumerated or resampled is one row a participant; the rows beneath are
reduced to sums first.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize, numbered

#: Most participants whose 2 ** n sign flips are enumerated.
MOST_FLIPPED = 16


def pair_sums(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Number, and centred sums of squares and products, of the complete pairs of each group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )


def repeated_measures_correlation(df: DataFrame, subject: str, x: str, y: str) -> DataFrame:
    """The correlation within participants: products over squares, each summed over participants; cut to -1..1."""
    sums = pair_sums(df, [subject], x, y).where("n >= 2").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_participants"), F.sum("sxx").alias("a"), F.sum("syy").alias("b"), F.sum("sxy").alias("c"))
    r = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b")))
    return sums.select("n_pairs", "n_participants", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("r"))


def leave_one_out_correlations(df: DataFrame, subject: str, x: str, y: str) -> DataFrame:
    """The within-participant correlation without each participant in turn, from sums less the own part."""
    sums = pair_sums(df, [subject], x, y).where("n >= 2")
    sums = materialize(sums, "sums")
    whole = sums.agg(*(F.sum(k).alias(k) for k in ("sxx", "syy", "sxy"))).first()
    a, b, c = (F.lit(whole[k]) - F.col(k) for k in ("sxx", "syy", "sxy"))
    return sums.select(subject, F.when((a > 0) & (b > 0), c / F.sqrt(a * b)).alias("r_without"))


def bootstrap(df: DataFrame, subject: str, value: str, draws: int, root: str, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """An interval of the median over participants, from ``draws`` resamples of them by hash.

    ``df`` has one row a participant. Each resample takes as many participants as
    there are, with replacement: the j-th is the one whose number the hash of
    (draw, j) gives.
    """
    rows, count = numbered(df.where(F.col(value).isNotNull()).select(subject, value), [subject], "i")
    rows = rows.withColumn("n", F.lit(count))
    slots = rows.select(F.col("i").alias("j"), "n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(root), F.col("draw").cast("string"), F.col("j").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    taken = slots.withColumn("i", F.pmod(number, F.col("n")))
    taken = join_bounded(taken, rows.select("i", value), ["i"])
    medians = taken.groupBy("draw").agg(F.median(value).alias("m"))
    low, high = (F.percentile("m", F.lit(p)) for p in levels)
    return medians.agg(F.count(F.lit(1)).alias("draws"), low.alias("low"), high.alias("high"))


def sign_flip(df: DataFrame, value: str, two_sided: bool = True) -> DataFrame:
    """The exact sign-flip test of a mean of 0: the share of all sign patterns that are as extreme, the given one included.

    ``df`` has one row a participant; at most 16 are enumerated. Result:
    ``n_participants``, ``mean``, ``p_value`` (null without participants).
    """
    values = [r[0] for r in df.where(F.col(value).isNotNull()).select(value).orderBy(value).limit(MOST_FLIPPED + 1).collect()]
    if len(values) > MOST_FLIPPED:
        raise ValueError(f"more than {MOST_FLIPPED} participants")
    p = mean = None
    if values:
        x = np.array(values)
        sums = np.array(list(product((1, -1), repeat=len(x)))) @ x
        seen, tolerance = x.sum(), 1e-12 * np.abs(x).sum()
        p = float(np.mean(np.abs(sums) >= abs(seen) - tolerance) if two_sided else np.mean(sums >= seen - tolerance))
        mean = float(x.mean())
    return df.sparkSession.createDataFrame([(len(values), mean, p)], "n_participants bigint, mean double, p_value double")


def holm(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Holm's adjusted p values: ranks multiply by the whole family's size, null ones counted, and never fall."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col(p).asc_nulls_last(), *[c for c in df.columns if c not in keys and c != p])
    raw = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("__raw", raw).withColumn("adjusted", F.when(F.col(p).isNotNull(), F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__raw")


def shift_null(df: DataFrame, subject: str, order: str, x: str, y: str, shifts: int) -> DataFrame:
    """The within-participant correlation at each circular shift of ``y`` along a participant's days, 0 to ``shifts``.

    Days are numbered, and a shift is an equality of numbers, so a shift costs one
    copy of the days.
    """
    w = Window.partitionBy(subject)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(subject, x, y, (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    left = rows.select(subject, x, "i", "n").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts)))).withColumn("i", F.pmod(F.col("i") + F.col("shift"), F.col("n")).cast("int"))
    both = left.join(rows.select(subject, y, "i"), [subject, "i"])
    sums = pair_sums(both, ["shift", subject], x, y).where("n >= 2").groupBy("shift").agg(F.sum("sxx").alias("a"), F.sum("syy").alias("b"), F.sum("sxy").alias("c"))
    return sums.select("shift", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))


def shift_p_value(shifted: DataFrame) -> DataFrame:
    """(shifts with a correlation as large as at shift 0 + 1) / (shifts + 1); a shift without correlation counts as larger."""
    seen = shifted.where("shift = 0").select(F.col("r").alias("seen"))
    rest = shifted.where("shift > 0").join(F.broadcast(seen))  # one row
    return rest.agg(F.count(F.lit(1)).alias("n_shifts"), ((F.count_if((F.col("r") >= F.col("seen")) | F.col("r").isNull()) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def common_gains(wide: DataFrame, keys: list[str], baseline: str, methods: list[str]) -> DataFrame:
    """The baseline's error less each method's, only where all of them are there; else null."""
    whole = F.col(baseline).isNotNull()
    for m in methods:
        whole = whole & F.col(m).isNotNull()
    return wide.select(*keys, *(F.when(whole, F.col(baseline) - F.col(m)).alias(f"gain_{m}") for m in methods))


def participant_summary(df: DataFrame, subject: str, value: str) -> DataFrame:
    """Each participant's median, then the median over participants and how many are positive: every participant weighs the same."""
    own = df.where(F.col(value).isNotNull()).groupBy(subject).agg(F.median(value).alias("m"))
    return own.agg(F.count(F.lit(1)).alias("n_participants"), F.median("m").alias("median"), F.count_if(F.col("m") > 0).alias("n_positive"))


def prediction_metrics(df: DataFrame, keys: list[str], label: str, p: str, clip: float = 1e-6) -> DataFrame:
    """Log loss (of p clipped), Brier score, accuracy and balanced accuracy at 0.5; the last null with one class."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - clip)), F.lit(clip))
    y = F.col(label)
    right = ((F.col(p) >= 0.5) == (y == 1)).cast("double")
    pos, neg = F.avg(F.when(y == 1, right)), F.avg(F.when(y == 0, right))
    return df.where(y.isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(right).alias("accuracy"),
        F.when(pos.isNotNull() & neg.isNotNull(), (pos + neg) / 2).alias("balanced_accuracy"),
    )


def change_metrics(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Mean absolute drift of a probability and the share of decisions (at 0.5) that flip."""
    return df.where(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(after) - F.col(before))).alias("drift"), F.avg(((F.col(before) >= 0.5) != (F.col(after) >= 0.5)).cast("double")).alias("flip_rate"))


def risk_at_coverage(df: DataFrame, keys: list[str], error: str, sure: str, share: float) -> DataFrame:
    """The mean error of the surest ``share`` of each group's rows, rounded up."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(error).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(F.col(sure).desc(), F.col(error))), "__n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("__r") <= F.ceil(F.col("__n") * share)).groupBy(*keys).agg(F.avg(error).alias("risk"), F.count(F.lit(1)).alias("kept"))


def participant_weights(df: DataFrame, subject: str) -> DataFrame:
    """``weight``: rows over participants times the participant's rows, so that each participant weighs the same."""
    own = df.groupBy(subject).agg(F.count(F.lit(1)).alias("__n"))
    own = materialize(own, "sizes")
    whole = own.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = own.withColumn("weight", F.lit(whole["n"]) / (F.lit(whole["k"]) * F.col("__n"))).drop("__n")
    return join_bounded(df, weights, [subject])


def bootstrap_correlation(df: DataFrame, subject: str, x: str, y: str, draws: int, root: str, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """An interval of the within-participant correlation from resamples of participants by hash, out of each one's sums."""
    rows, count = numbered(pair_sums(df, [subject], x, y).where("n >= 2").select(subject, "sxx", "syy", "sxy"), [subject], "i")
    rows = rows.select("sxx", "syy", "sxy", "i", F.lit(count).alias("k"))
    slots = rows.select(F.col("i").alias("j"), "k").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(root), F.col("draw").cast("string"), F.col("j").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    taken = slots.withColumn("i", F.pmod(number, F.col("k")))
    taken = join_bounded(taken, rows.drop("k"), ["i"])
    r = taken.groupBy("draw").agg(F.sum("sxx").alias("a"), F.sum("syy").alias("b"), F.sum("sxy").alias("c")).select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))
    return r.agg(F.count("r").alias("draws"), F.percentile("r", F.lit(levels[0])).alias("low"), F.percentile("r", F.lit(levels[1])).alias("high"))


def max_sign_flip(df: DataFrame, candidate: str, subject: str, value: str) -> DataFrame:
    """One-sided sign-flip p values of several candidates against the largest mean of all candidates in each sign pattern.

    Each participant's sign flips in all candidates alike. One row a candidate and
    participant, complete; at most 16 participants and 1,000 candidates.
    """
    rows = df.select(candidate, subject, value).limit(MOST_FLIPPED * 1000 + 1).collect()
    people, names = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    if len(people) > MOST_FLIPPED or len(names) > 1000 or len(rows) != len(people) * len(names):
        raise ValueError("candidates must have the same participants, at most 16")
    table = np.zeros((len(people), len(names)))
    for c, s, v in rows:
        table[people.index(s), names.index(c)] = v
    out = []
    if people:
        means = np.array(list(product((1, -1), repeat=len(people)))) @ table / len(people)
        top = means.max(1)
        out = [(n, float(table[:, i].mean()), float(np.mean(top >= table[:, i].mean() - 1e-12))) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(out, f"{candidate} string, mean double, p_value double")


def residual_correlation(df: DataFrame, subject: str, x: str, y: str, nuisance: list[str]) -> DataFrame:
    """The within-participant correlation of what is left of x and y after linear effects of the nuisance columns.

    For each participant the effects are fitted to all others, from sums of
    products less the own part (columns centred within participants; a column
    without variation of its own gets no effect). Only sums, one small matrix a
    participant, are gathered: at most 10,000 participants.
    """
    cols = [x, y, *nuisance]
    full = df
    for c in cols:
        full = full.where(F.col(c).isNotNull())
    w = Window.partitionBy(subject)
    centred = full.select(subject, *((F.col(c) - F.avg(c).over(w)).alias(f"__{i}") for i, c in enumerate(cols)))
    k = len(cols)
    sums = centred.groupBy(subject).agg(*(F.sum(F.col(f"__{i}") * F.col(f"__{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).orderBy(subject).limit(10_001).collect()
    if len(sums) > 10_000:
        raise ValueError("more than 10000 participants")
    mats = []
    for r in sums:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        mats.append(m)
    total, out = np.sum(mats, axis=0) if mats else np.zeros((k, k)), []
    for r, own in zip(sums, mats):
        rest = total - own
        beta = np.linalg.lstsq(rest[2:, 2:], rest[2:, :2], rcond=1e-10)[0]
        left = own[:2, :2] - beta.T @ own[2:, :2] - own[:2, 2:] @ beta + beta.T @ own[2:, 2:] @ beta
        out.append((r[subject], float(left[0, 0]), float(left[1, 1]), float(left[0, 1])))
    frame = df.sparkSession.createDataFrame(out, f"{subject} string, a double, b double, c double")
    return frame.agg(F.count(F.lit(1)).alias("n_participants"), F.when((F.sum("a") > 0) & (F.sum("b") > 0), F.sum("c") / F.sqrt(F.sum("a") * F.sum("b"))).alias("r"))


def calibration(df: DataFrame, label: str, p: str, steps: int = 25) -> DataFrame:
    """Intercept and slope of a logistic recalibration of log odds, by Newton's method on sums; null with one class or constant odds."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(F.col(label).cast("double").alias("y"), F.log(q / (1 - q)).alias("z"))
    rows = materialize(rows, "odds")
    n, ones, spread = rows.agg(F.count(F.lit(1)), F.sum("y"), F.stddev_pop("z")).first()
    a = b = None
    if n and 0 < ones < n and spread:
        a, b = math.log(ones / (n - ones)), 0.0  # from no slope Newton's steps don't overshoot
        for _ in range(steps):
            m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
            g = rows.agg(F.sum(F.col("y") - m), F.sum((F.col("y") - m) * F.col("z")), F.sum(m * (1 - m)), F.sum(m * (1 - m) * F.col("z")), F.sum(m * (1 - m) * F.col("z") * F.col("z"))).first()
            det = g[2] * g[4] - g[3] ** 2
            if det <= 1e-12:
                break
            da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-10:
                break
    return df.sparkSession.createDataFrame([(n, a, b)], "n bigint, intercept double, slope double")


def family_inference(df: DataFrame, family: str, subject: str, value: str, draws: int = 999, root: str = "gapline") -> DataFrame:
    """The two-sided sign-flip test of each family's mean, adjusted over families by Holm: ``family``, ``n_participants``, ``mean``, ``p_value``, ``adjusted``.

    One row a family and participant. Up to 16 participants all 2 ** n sign
    patterns are enumerated, the given one included: a pattern is a number whose
    bits are signs. Beyond, ``draws`` patterns come from hashes of draw and
    participant, and the given one counts as one more.
    """
    w = Window.partitionBy(family)
    rows = df.where(F.col(value).isNotNull()).select(family, subject, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__i", (F.row_number().over(w.orderBy(subject)) - 1).cast("int"))
    sizes = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n_participants"), F.avg("__v").alias("mean"), F.sum("__v").alias("__s"), F.sum(F.abs("__v")).alias("__a"))
    exact = F.col("n_participants") <= MOST_FLIPPED
    last = F.when(exact, F.expr("shiftleft(1, cast(least(n_participants, 30) as int)) - 1")).otherwise(F.lit(draws - 1))
    patterns = sizes.withColumn("__exact", exact).withColumn("__k", F.explode(F.sequence(F.lit(0), last)))
    drawn = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(root), F.col("__k").cast("string"), F.col(subject).cast("string")), 256), 1, 15), 16, 10).cast("bigint"), F.lit(2))
    flip = F.when(F.col("__exact"), F.expr("shiftright(__k, __i) & 1").cast("bigint")).otherwise(drawn) == 1
    both = patterns.select(family, "__k", "__s", "__a", "__exact").join(rows, family)
    sums = both.groupBy(family, "__k").agg(F.sum(F.when(flip, -F.col("__v")).otherwise(F.col("__v"))).alias("__f"), *(F.first(c).alias(c) for c in ("__s", "__a", "__exact")))
    far = F.count_if(F.abs("__f") >= F.abs("__s") - 1e-9 * F.col("__a"))
    n = F.count(F.lit(1))
    p = sums.groupBy(family).agg(F.when(F.first("__exact"), far / n).otherwise((far + 1) / (n + 1)).alias("p_value"))
    out = sizes.select(family, "n_participants", "mean").join(p, family).withColumn("__every", F.lit(1))
    return holm(out.select("__every", family, "n_participants", "mean", "p_value"), ["__every"], "p_value").drop("__every")


def cyclic_derangements(people: DataFrame, subject: str, draws: int, root: str) -> DataFrame:
    """For each draw another donor for each participant, all different: ``draw``, ``subject``, ``donor``.

    Participants are ordered by the hash of draw and name, and each gets the next
    one's: no one gets its own, and nothing has to be drawn again. With one
    participant there is none.
    """
    each = people.select(subject).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = F.sha2(F.concat_ws("|", F.lit(root), F.col("draw").cast("string"), F.col(subject).cast("string")), 256)
    w = Window.partitionBy("draw").orderBy(order, subject)
    return each.withColumn("donor", F.coalesce(F.lead(subject).over(w), F.first(subject).over(w))).where(F.col("donor") != F.col(subject))


def derangement_scores(assigned: DataFrame, pairs: DataFrame, subject: str, own: str) -> DataFrame:
    """Per draw how much better the own value is than the donor's, on average, and whether donors are as good: ``draw``, ``n``, ``mean_gain``, ``as_good``.

    ``pairs``: one row a participant with its error ``own``.
    """
    mine = pairs.select(subject, F.col(own).alias("__own"))
    theirs = pairs.select(F.col(subject).alias("donor"), F.col(own).alias("__donor"))
    both = assigned.join(mine, subject).join(theirs, "donor")
    out = both.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("__donor") - F.col("__own")).alias("mean_gain"))
    return out.withColumn("as_good", F.col("mean_gain") <= 1e-12)


def weekday_shift_null(df: DataFrame, subject: str, day: str, x: str, y: str, shifts: int) -> DataFrame:
    """As ``shift_null``, with ``y`` moved among the days of the same weekday of a participant only."""
    w = Window.partitionBy(subject, "__d")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(subject, x, y, F.col(day).alias("__day"), F.weekday(day).alias("__d"))
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("__day")) - 1, "n": F.count(F.lit(1)).over(w)})
    left = rows.select(subject, "__d", x, "i", "n").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts)))).withColumn("i", F.pmod(F.col("i") + F.col("shift"), F.col("n")).cast("int"))
    both = left.join(rows.select(subject, "__d", y, "i"), [subject, "__d", "i"])
    sums = pair_sums(both, ["shift", subject], x, y).where("n >= 2").groupBy("shift").agg(F.sum("sxx").alias("a"), F.sum("syy").alias("b"), F.sum("sxy").alias("c"))
    return sums.select("shift", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))
