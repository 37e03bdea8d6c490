"""Episodes of days: a hidden semi-Markov model with explicit durations, in numpy, one participant's sequences a task.

A state lasts 1 to ``most`` bins with its own distribution of durations.
Emissions are independent Gaussians; missing values say nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 12


@dataclass
class DurationModel:
    mean: np.ndarray
    sd: np.ndarray
    initial: np.ndarray
    transition: np.ndarray
    duration: np.ndarray


def emission(model: DurationModel, x: np.ndarray) -> np.ndarray:
    """Log densities (steps, states) of values (steps, domains)."""
    z = (x[:, None, :] - model.mean[None]) / model.sd[None]
    d = -0.5 * z**2 - np.log(model.sd)[None] - 0.5 * np.log(2 * np.pi)
    return np.where(np.isnan(x)[:, None, :], 0.0, d).sum(2)


def viterbi(score: np.ndarray, initial: np.ndarray, transition: np.ndarray, duration: np.ndarray) -> np.ndarray:
    """The states of the best segmentation. All in logs; the last segment may be cut by the end."""
    steps, states = score.shape
    most = duration.shape[1]
    upto = np.vstack([np.zeros(states), np.cumsum(score, axis=0)])
    # A cut segment has at least the length that is seen.
    tail = np.logaddexp.accumulate(duration[:, ::-1], axis=1)[:, ::-1]
    best = np.full((steps + 1, states), -np.inf)
    back = np.zeros((steps + 1, states, 2), int)
    for t in range(1, steps + 1):
        for d in range(1, min(most, t) + 1):
            stay = (tail if t == steps else duration)[:, d - 1]
            if t == d:
                come, origin = initial, np.full(states, -1)
            else:
                into = best[t - d][:, None] + transition
                come, origin = into.max(0), into.argmax(0)
            value = come + stay + upto[t] - upto[t - d]
            better = value > best[t]
            best[t] = np.where(better, value, best[t])
            back[t, better, 0] = d
            back[t, better, 1] = origin[better]
    path = np.zeros(steps, int)
    t, s = steps, int(best[steps].argmax())
    while t > 0:
        d, origin = back[t, s]
        path[t - d : t] = s
        t, s = t - d, int(origin)
    return path


def _runs(path: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(path)) + 1
    edges = np.concatenate([[0], cut, [len(path)]])
    return [(int(path[a]), int(b - a)) for a, b in zip(edges, edges[1:])]


def fit(sequences: list[np.ndarray], states: int, rounds: int = 20, most: int = MOST, seed: int = 0) -> DurationModel:
    """Hard EM from quantile starts, until the paths repeat. Counts are smoothed by one tenth."""
    x = np.vstack(sequences)
    domains = x.shape[1]
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    order = np.argsort(filled.sum(1), kind="stable")
    path_all = np.empty(len(x), int)
    path_all[order] = np.arange(len(x)) * states // len(x)
    ends = np.cumsum([len(s) for s in sequences])
    paths = np.split(path_all, ends[:-1])
    model = None
    for _ in range(rounds):
        mean, sd = np.zeros((states, domains)), np.ones((states, domains))
        initial, transition, duration = np.full(states, 0.1), np.full((states, states), 0.1), np.full((states, most), 0.1)
        flat = np.concatenate(paths)
        for s in range(states):
            own = x[flat == s]
            for d in range(domains):
                v = own[:, d][~np.isnan(own[:, d])] if len(own) else np.array([])
                mean[s, d] = v.mean() if len(v) else np.nanmean(x[:, d])
                sd[s, d] = max(v.std() if len(v) > 1 else np.nanstd(x[:, d]), 1e-2)
        for p in paths:
            runs = _runs(p)
            initial[runs[0][0]] += 1
            for (a, _), (b, _) in zip(runs, runs[1:]):
                transition[a, b] += 1
            for s, n in runs:
                while n > 0:
                    duration[s, min(n, most) - 1] += 1
                    n -= most
        # A longer stay is a segment followed by another of the same state.
        log = lambda m: np.log(m / m.sum(-1, keepdims=True))
        model = DurationModel(mean, sd, log(initial), log(transition), log(duration))
        new = [viterbi(emission(model, s), model.initial, model.transition, model.duration) for s in sequences]
        if all((a == b).all() for a, b in zip(new, paths)):
            break
        paths = new
    return model


def decode(df: DataFrame, subject: str, day: str, step: str, values: list[str], states: int = 4) -> DataFrame:
    """The state of each step, from a model fitted to each participant's days. States are numbered by rising mean of the first value."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([day, step])
        groups = [g for _, g in pdf.groupby(day, sort=True)]
        sequences = [g[values].to_numpy(float) for g in groups]
        model = fit(sequences, states)
        rank = np.argsort(np.argsort(model.mean[:, 0], kind="stable"), kind="stable")
        paths = [rank[viterbi(emission(model, s), model.initial, model.transition, model.duration)] for s in sequences]
        return pd.concat([pd.DataFrame({subject: g[subject], day: g[day], step: g[step], "state": p}) for g, p in zip(groups, paths)])

    kinds = dict(df.dtypes)
    return df.select(subject, day, step, *values).groupBy(subject).applyInPandas(one, f"{subject} {kinds[subject]}, {day} {kinds[day]}, {step} {kinds[step]}, state int")


def assignment(gain: np.ndarray) -> np.ndarray:
    """For each row the column that it is given, so that the sum of ``gain`` over the pairs is greatest: shortest augmenting paths, for any size."""
    n = len(gain)
    cost = np.zeros((n + 1, n + 1))
    cost[1:, 1:] = gain.max(initial=0) - gain
    row_price, column_price, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        reach, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at]] - row_price[owner[at]] - column_price
            better = ~done & (slack < reach)
            better[0] = False
            reach[better], came[better] = slack[better], at
            open_ = np.where(done, np.inf, reach)
            open_[0] = np.inf
            nearest = int(open_.argmin())
            step = open_[nearest]
            row_price[owner[done]] += step
            column_price[done] -= step
            reach[~done] -= step
            at = nearest
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    given = np.zeros(n, int)
    given[owner[1:] - 1] = np.arange(n)
    return given


def aligned(reference: np.ndarray, candidate: np.ndarray, states: int) -> np.ndarray:
    """The candidate's labels renamed to agree with the reference in as many steps as possible."""
    counts = np.zeros((states, states), int)
    np.add.at(counts, (candidate, reference), 1)
    # Among equals a label keeps its number.
    return assignment(counts + np.eye(states) / (4.0 * states))[candidate]


def segment_iou(reference: np.ndarray, predicted: np.ndarray, states: int) -> float:
    """Intersections over unions of the labels, paired so that their sum is greatest, over the larger number of labels in use; 1 if there is none."""
    both = np.zeros((states, states))
    for a in range(states):
        for b in range(states):
            union = ((reference == a) | (predicted == b)).sum()
            both[a, b] = ((reference == a) & (predicted == b)).sum() / union if union else 0.0
    used = max(len(np.unique(reference)), len(np.unique(predicted)))
    return float(both[np.arange(states), assignment(both)].sum() / used) if used else 1.0


def boundary_f1(reference: np.ndarray, predicted: np.ndarray, tolerance: int = 1) -> float:
    """F1 of boundaries matched one to one, from the left, at most ``tolerance`` bins apart; 1 if neither has any."""
    i = j = hit = 0
    reference, predicted = np.sort(reference), np.sort(predicted)
    while i < len(reference) and j < len(predicted):
        if abs(reference[i] - predicted[j]) <= tolerance:
            hit, i, j = hit + 1, i + 1, j + 1
        elif reference[i] < predicted[j]:
            i += 1
        else:
            j += 1
    n = len(reference) + len(predicted)
    return 2 * hit / n if n else 1.0


def certified(original: np.ndarray, perturbed: list[np.ndarray], states: int, share: float = 1.0, unknown: int = -1) -> np.ndarray:
    """The original labels where at least ``share`` of the aligned perturbed paths agree, else ``unknown``."""
    votes = np.mean([aligned(original, p, states) == original for p in perturbed], axis=0)
    return np.where(votes >= share, original, unknown)


def bic(sequences: list[np.ndarray], model: DurationModel) -> float:
    """Bayes' information criterion of the best paths."""
    states, domains = model.mean.shape
    free = states * 2 * domains + states - 1 + states * (states - 1) + states * (model.duration.shape[1] - 1)
    score = 0.0
    for s in sequences:
        e = emission(model, s)
        path = viterbi(e, model.initial, model.transition, model.duration)
        runs = _runs(path)
        score += e[np.arange(len(s)), path].sum() + model.initial[runs[0][0]] + sum(model.transition[a, b] for (a, _), (b, _) in zip(runs, runs[1:])) + sum(model.duration[a, min(n, model.duration.shape[1]) - 1] for a, n in runs)
    return free * np.log(sum(len(s) for s in sequences)) - 2 * score


def select_states(sequences: list[np.ndarray], candidates: tuple[int, ...] = (4, 6, 8)) -> int:
    """The number of states with the least criterion; ties go to the smaller number."""
    return min(candidates, key=lambda k: (round(bic(sequences, fit(sequences, k)), 9), k))


def episode_batch(spark, seed: int, people: int = 10, days: int = 14, bins: int = 48, domains: int = 6, states: int = 4, shift: float = 0.0, available: float = 0.9) -> DataFrame:
    """Synthetic days with a known truth: ``participant``, ``day``, ``bin``, ``state`` and ``d0``, ``d1``, ... (null where nothing was recorded).

    States last a geometric number of half hours and never follow themselves;
    each has a mean in each domain, the clock adds a wave, and participants lie
    ``shift`` apart. A participant's days follow from the seed and its number, so
    they are made where they are needed, in any number of tasks.
    """
    values = [f"d{i}" for i in range(domains)]
    common = np.random.default_rng(seed)
    means = common.normal(0, 2, (states, domains))

    def make(batches):
        for pdf in batches:
            for person in pdf["id"]:
                rng = np.random.default_rng([seed, int(person)])
                parts = []
                for day in range(days):
                    truth, at, state = np.empty(bins, int), 0, int(rng.integers(states))
                    while at < bins:
                        n = min(bins - at, 1 + int(rng.geometric(0.2)))
                        truth[at : at + n] = state
                        at, state = at + n, (state + 1 + int(rng.integers(states - 1))) % states
                    clock = np.sin(2 * np.pi * np.arange(bins) / bins)[:, None]
                    x = means[truth] + 0.5 * clock + shift * int(person) + rng.normal(0, 1, (bins, domains))
                    x[rng.random((bins, domains)) > available] = np.nan
                    frame = pd.DataFrame(x, columns=values)
                    frame.insert(0, "state", truth)
                    frame.insert(0, "bin", np.arange(bins))
                    frame.insert(0, "day", day)
                    frame.insert(0, "participant", int(person))
                    parts.append(frame)
                yield pd.concat(parts).astype({v: object for v in values}).where(lambda f: f.notna(), None)

    schema = "participant int, day int, bin int, state int, " + ", ".join(f"{v} double" for v in values)
    return spark.range(0, people, 1, min(people, 8)).mapInPandas(make, schema)


def induced_masks(days: DataFrame, keys: list[str], root: str, draws: int = 4, bins: int = 48, domains: int = 6) -> DataFrame:
    """Masks of bins for each day and draw: contiguous_20pct, ten of 48 in every domain, and outage_1h, two in one domain: ``kind``, ``draw``, ``domain`` (null: all), ``first_bin``, ``last_bin``."""
    number = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(root), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("bigint")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in (("contiguous_20pct", 10), ("outage_1h", 2))))
    each = days.select(*keys).distinct().withColumn("x", F.explode(kinds)).select(*keys, "x.kind", "x.n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    names = [F.col("kind"), F.col("draw"), *(F.col(k) for k in keys)]
    start = F.pmod(number(*names), F.lit(bins) - F.col("n") + 1).cast("int")
    domain = F.when(F.col("kind") == "outage_1h", F.pmod(number(F.lit("domain"), *names), F.lit(domains)).cast("int"))
    return each.select(*keys, "kind", "draw", domain.alias("domain"), start.alias("first_bin"), (start + F.col("n") - 1).cast("int").alias("last_bin"))
