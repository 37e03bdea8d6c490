"""Leave-one-participant-out models and the preparation of their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.robust import others_median_rows
from gapline.operators.inference import participant_weights
from gapline.staging import materialize


def fold_preparation(df: DataFrame, subject: str, features: list[str]) -> DataFrame:
    """Each fold's medians, means and deviations of the features, over all participants but the held-out one.

    Features are in rows: ``held_out``, ``feature``, ``median``, ``mean``, ``sd``. Means
    and deviations are sums less the own part, medians come from ranks: no row is
    copied to another fold. A participant alone has no fold.
    """
    long = df.unpivot([subject], features, "feature", "x").where("x is not null")
    mid = others_median_rows(long, ["feature"], subject, "x", "median")
    center = long.groupBy("feature").agg(F.avg("x").alias("__c"))
    own = long.join(F.broadcast(center), "feature").withColumn("__d", F.col("x") - F.col("__c"))  # one row a feature
    sums = own.groupBy(subject, "feature").agg(F.count("x").alias("n"), F.sum("__d").alias("s"), F.sum(F.col("__d") * F.col("__d")).alias("q"), F.first("__c").alias("c"))
    folds = df.select(subject).distinct()
    total = sums.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.first("c").alias("c"))
    grid = folds.withColumn("feature", F.explode(F.array(*map(F.lit, features)))).join(F.broadcast(total), "feature").join(sums.drop("c"), [subject, "feature"], "left").na.fill(0, ["n"]).na.fill(0.0, ["s", "q"])
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    stats = grid.where(n > 0).select(subject, "feature", (F.col("c") + s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"), F.col("n").alias("own"))
    whole = mid.select(subject, "feature", "median")
    # A participant without values of a feature leaves out nothing: its fold has the median of all.
    every = long.groupBy("feature").agg(F.median("x").alias("all_median"))
    out = stats.join(whole, [subject, "feature"], "left").join(F.broadcast(every), "feature")
    return out.select(F.col(subject).alias("held_out"), "feature", F.when(F.col("own") > 0, F.col("median")).otherwise(F.col("all_median")).alias("median"), "mean", "sd")


def loso_logistic(df: DataFrame, subject: str, label: str, features: list[str], l2: float = 0.1, iterations: int = 2000) -> DataFrame:
    """Out-of-participant probabilities of a logistic regression: ``subject``, ``label``, ``probability``, ``prior``, one fold a participant.

    In a fold each training participant weighs the same, however many rows there
    are: in the features' means and deviations, the regression, and the ``prior``,
    the training rows' prevalence. Missing features take the training median, and
    a fold with one class gives its smoothed prevalence (n1 + 1) / (n + 2), n1 by
    weight. Rows without label aren't used. A regression that hasn't converged
    after ``iterations`` is an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.where(F.col(label).isNotNull()).select(subject, F.col(label).cast("double").alias(label), *features)
    rows = materialize(rows, "labelled")
    people = [r[0] for r in rows.select(subject).distinct().orderBy(subject).limit(1001).collect()]
    if len(people) > 1000:
        raise ValueError("more than 1000 folds")
    filled = [f"__filled_{f}" for f in features]
    out = None
    for person in people:
        test = rows.where(F.col(subject) == person)
        train = participant_weights(rows.where(F.col(subject) != person), subject).withColumnRenamed("weight", "__weight")
        n, total, ones, least, most = train.agg(F.count(F.lit(1)), F.sum("__weight"), F.sum(F.col("__weight") * F.col(label)), F.min(label), F.max(label)).first()
        prior = F.lit(ones / total if n else None).cast("double").alias("prior")
        if not n or least == most:
            got = test.select(subject, label, F.lit(((ones or 0.0) + 1) / ((total or 0.0) + 2)).alias("probability"), prior)
        else:
            full = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(train)
            ready = full.transform(train)
            weigh = lambda x: F.sum(F.col("__weight") * x) / F.sum("__weight")
            mean = ready.agg(*[weigh(F.col(f)).alias(f) for f in filled]).first()
            var = ready.agg(*[weigh((F.col(f) - mean[f]) ** 2).alias(f) for f in filled]).first()
            scaled = lambda d: d.withColumns({f: (F.col(f) - mean[f]) / (var[f] ** 0.5 or 1.0) for f in filled})  # noqa: E731, B023
            pack = VectorAssembler(inputCols=filled, outputCol="__packed")
            data = pack.transform(scaled(ready)).select("__packed", label, "__weight").cache()
            model = LogisticRegression(featuresCol="__packed", labelCol=label, weightCol="__weight", regParam=l2, standardization=False, maxIter=iterations, tol=1e-10).fit(data)
            data.unpersist()
            if model.summary.totalIterations >= iterations:
                raise ValueError(f"no convergence after {iterations} iterations without {person}")
            got = model.transform(pack.transform(scaled(full.transform(test)))).select(subject, label, vector_to_array("probability")[1].alias("probability"), prior)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.select(subject, label, F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("prior"))
