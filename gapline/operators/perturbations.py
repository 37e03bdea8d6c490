"""Structured losses of a prepared view, and how far they take its feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.operators.primitives import VIEW, coverage_of, values_of
from gapline.staging import materialize

#: Kept shares of random and periodic losses, and lengths of outages in minutes.
SHARES, OUTAGES = (90, 70, 50), (60, 180)
NAMES = (*(f"random_{s}" for s in SHARES), *(f"periodic_{s}" for s in SHARES), *(f"outage_{m // 60}h" for m in OUTAGES), "cadence_x3")
#: Perturbations of a view: the names of its rows.
BY = [*VIEW, "perturbation"]


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("bigint")


def perturbed(framed: DataFrame, root: str) -> DataFrame:
    """The counted readings that each of ``NAMES`` leaves of each view, with ``perturbation``.

    random_p keeps p percent (rounded up) by hash. periodic_p keeps as many, evenly
    spread from the first to the last. outage_h loses the readings of h hours
    from a hashed whole minute of the window on. cadence_x3 keeps every third.
    """
    rows = framed.where("ok")
    w = Window.partitionBy("view_id")
    ident = F.col("record_id").cast("string")
    hashed = F.sha2(F.concat_ws("|", F.lit(root), ident), 256)
    placed = rows.withColumns({"__i": F.row_number().over(w.orderBy("effective_timestamp", "record_id")) - 1, "__r": F.row_number().over(w.orderBy(hashed, "record_id")), "__n": F.count(F.lit(1)).over(w)})
    n, i = F.col("__n"), F.col("__i")
    kept: list[tuple[str, Column]] = []
    for s in SHARES:
        k = F.ceil(n * s / 100 - 1e-9)
        kept.append((f"random_{s}", F.col("__r") <= k))
    for s in SHARES:
        k = F.ceil(n * s / 100 - 1e-9)
        # Position i is kept if it is floor(j (n - 1) / (k - 1)) for some j.
        j = F.ceil(i * (k - 1) / F.greatest(n - 1, F.lit(1)) - 1e-12)
        kept.append((f"periodic_{s}", (k >= n) | ((k <= 1) & (i == 0)) | ((k > 1) & (F.floor(j * (n - 1) / F.greatest(k - 1, F.lit(1)) + 1e-12) == i))))
    length = F.col("expected_epochs") * F.col("cadence_minutes")
    first = 1440 - length
    for m in OUTAGES:
        start = first + F.pmod(_number(F.lit(root), F.lit(str(m)), F.col("view_id").cast("string")), length - m + 1)
        kept.append((f"outage_{m // 60}h", ~((F.col("minute") >= start) & (F.col("minute") < start + m))))
    kept.append(("cadence_x3", i % 3 == 0))
    left = placed.withColumn("perturbation", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in kept)))))
    return left.drop("__i", "__r", "__n")


def deficits(framed: DataFrame, root: str) -> DataFrame:
    """What each perturbation takes from each view: ``kept_share``, ``coverage_deficit``, ``gap_increase`` (share of the window), ``value``, ``perturbed_value``.

    Deficits of coverage and gap are null in event support. A perturbation that
    leaves nothing has no value and a kept share of 0.
    """
    rows = framed.where("ok")
    left = materialize(perturbed(framed, root), "perturbed")
    whole = coverage_of(rows).join(values_of(rows).select("view_id", "value"), "view_id", "left")
    size = rows.groupBy("view_id").agg(F.first(F.col("expected_epochs") * F.col("cadence_minutes")).alias("minutes"))
    after = coverage_of(left, BY).select("view_id", "perturbation", F.col("n_valid").alias("k"), F.col("coverage").alias("c"), F.col("longest_gap_minutes").alias("g")).join(values_of(left, BY).select("view_id", "perturbation", F.col("value").alias("perturbed_value")), ["view_id", "perturbation"], "left")
    grid = whole.join(size, "view_id").withColumn("perturbation", F.explode(F.array(*map(F.lit, NAMES))))
    both = grid.join(after, ["view_id", "perturbation"], "left")
    there = F.col("coverage").isNotNull()
    return both.select(
        *BY, (F.coalesce("k", F.lit(0)) / F.col("n_valid")).alias("kept_share"), F.when(there, 1 - F.coalesce("c", F.lit(0.0)) / F.col("coverage")).alias("coverage_deficit"),
        F.when(there, (F.coalesce("g", F.col("minutes").cast("double")) - F.col("longest_gap_minutes")) / F.col("minutes")).alias("gap_increase"), "value", "perturbed_value",
    )


def applicability_model(df: DataFrame, subject: str, features: list[str], label: str, l2: float = 0.5, steps: int = 400) -> dict[str, list[float]]:
    """Of each participant held out the intercept and non-negative weights of a logistic risk, fitted to all others by projected gradient.

    Only sums, one vector a participant and step, are gathered: rows stay where
    they are. At most 200 participants and 20 features (an error beyond).
    """
    import numpy as np

    people = [r[0] for r in df.select(subject).distinct().orderBy(subject).limit(201).collect()]
    if len(people) > 200 or len(features) > 20:
        raise ValueError("more than 200 participants or 20 features")
    # Rows of equal features and label are one row with a count.
    rows = df.groupBy(subject, *features, label).agg(F.count(F.lit(1)).alias("__n")).toPandas()
    out = {}
    for person in people:
        part = rows[rows[subject] != person]
        x, y, n = np.c_[np.ones(len(part)), part[features].to_numpy(float)], part[label].to_numpy(float), part["__n"].to_numpy(float)
        beta = np.zeros(x.shape[1])
        if len(part):
            rate = 4.0 / (n.sum() * max(1.0, float((x * x).sum(1).max())) + l2)
            for _ in range(steps):
                p = 1 / (1 + np.exp(-x @ beta))
                grad = x.T @ (n * (p - y)) + l2 * np.r_[0.0, beta[1:]]
                beta = beta - rate * grad
                beta[1:] = np.maximum(beta[1:], 0)
        out[person] = [float(b) for b in beta]
    return out
