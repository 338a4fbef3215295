"""Thresholds, firing, and how well alarms tell failed runs from good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running_sums, upper_nearest_rank

METRICS = ("precision", "recall", "f1", "fpr", "flag_rate", "earliness_frac", "earliness_step")


def peaks(scores: DataFrame, warmup: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """run_id, peak: the highest score from step `warmup` on, of runs that reach it."""
    return scores.filter(F.col("pos") >= warmup - 1).groupBy(*keys, "run_id").agg(F.max("score").alias("peak"))


def threshold(run_peaks: DataFrame, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The upper nearest-rank quantile of the peaks, of any number; infinity without any."""
    found = upper_nearest_rank(run_peaks, "peak", q, keys).withColumnRenamed("peak", "threshold")
    return found if keys else found.agg(F.coalesce(F.max("threshold"), F.lit(float("inf"))).alias("threshold"))


def calibrate(scores: DataFrame, trusted: DataFrame, warmup: int = 3, target_fpr: float = 0.1) -> DataFrame:
    """Threshold from trusted runs: at most `target_fpr` of their peaks lie above it."""
    return threshold(peaks(scores.join(trusted.filter("success").select("run_id"), "run_id", "left_semi"), warmup), 1 - target_fpr)


def leave_one_out(distances: DataFrame, bank: DataFrame) -> DataFrame:
    """Of distances of bank runs to the bank, those to other runs (run_id, pos, bank_idx, ...)."""
    own = bank.select(F.col("ref_id").alias("run_id"), F.col("bank_idx").alias("_own"))
    return distances.join(F.broadcast(own), "run_id").filter("bank_idx <> _own").drop("_own")


def decide(scores: DataFrame, thresholds: DataFrame, warmup: int = 3, patience: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """run_id, fired, step, frac, peak, n: fires after `patience` steps in a row above the threshold.

    `thresholds` has one row for each value of `keys` (one row without keys).
    """
    met = scores.join(F.broadcast(thresholds), list(keys)) if keys else scores.join(F.broadcast(thresholds))
    return decide_over(met.withColumn("over", (F.col("score") > F.col("threshold")) & (F.col("pos") + 1 >= warmup)), patience, keys)


def decide_over(met: DataFrame, patience: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """decide() for rows that say already whether they are `over` their threshold."""
    run = W.partitionBy(*keys, "run_id").orderBy("pos")
    # steps over the threshold that follow each other share place minus rank
    island = F.col("pos") - F.sum(F.col("over").cast("int")).over(run)
    streak = F.row_number().over(W.partitionBy(*keys, "run_id", "over", "island").orderBy("pos"))
    met = met.withColumn("island", island).withColumn("streak", F.when(F.col("over"), streak).otherwise(0))
    out = met.groupBy(*keys, "run_id").agg(
        F.min(F.when(F.col("streak") >= patience, F.col("pos") + 1)).alias("step"), F.max("score").alias("peak"), (F.max("pos") + 1).alias("n"))
    return out.select(*keys, "run_id", F.col("step").isNotNull().alias("fired"), "step", (F.col("step") / F.col("n")).alias("frac"), "peak", "n")


def fired_steps(curves: DataFrame, thresholds: str, patience: int = 2) -> DataFrame:
    """The columns of `curves` but curve and thresholds, and q, w, threshold, step: where each threshold fires.

    A row holds a whole curve (array) and the thresholds it meets (array of
    structs q, w, start, threshold). A threshold fires where the least of
    `patience` scores in a row, all from step `start` on, lies above it.
    """
    rest = [c for c in curves.columns if c not in ("curve", thresholds)]
    least = F.col("curve")
    for p in range(1, patience):  # the least of each score and the p before it
        cut = F.greatest(F.size("curve") - p, F.lit(0))
        least = F.zip_with(F.slice(least, F.lit(1), cut), F.slice("curve", F.lit(p + 1), cut), lambda x, y: F.least(x, y))
    rows = curves.withColumn("_least", least).select(*rest, "_least", F.inline(thresholds))
    # place i of _least is the streak that ends at step i + patience - 1
    late = F.slice("_least", F.col("start"), F.greatest(F.size("_least") - F.col("start") + 1, F.lit(0)))
    place = F.array_position(F.transform(late, lambda x: x > F.col("threshold")), F.lit(True))
    step = F.when(place > 0, (place + F.col("start") + (patience - 2)).cast("int"))
    return rows.select(*rest, "q", "w", "threshold", step.alias("step"))


def metrics(decisions: DataFrame, outcomes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The seven metrics; a failed run is the positive class; undefined ones are null."""
    return metrics_of(decisions.join(outcomes.select("run_id", "success"), "run_id"), keys)


def metrics_of(d: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """metrics() of decisions (fired, step, frac) that know their run's success."""
    n = lambda x: F.sum(x.cast("int"))
    fired, bad = F.col("fired"), ~F.col("success")
    c = d.groupBy(*keys).agg(
        n(fired & bad).alias("tp"), n(fired & ~bad).alias("fp"), n(bad).alias("pos"), n(~bad).alias("neg"), F.count("*").alias("runs"),
        F.avg(F.when(fired & bad, F.col("frac"))).alias("earliness_frac"), F.avg(F.when(fired & bad, F.col("step"))).alias("earliness_step"))
    none_if_0 = lambda x: F.nullif(x, F.lit(0))
    p, r = F.col("tp") / none_if_0(F.col("tp") + F.col("fp")), F.col("tp") / none_if_0(F.col("pos"))
    return c.select(*keys, "tp", "fp", "pos", "neg", "runs", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), (F.col("fp") / none_if_0(F.col("neg"))).alias("fpr"), ((F.col("tp") + F.col("fp")) / F.col("runs")).alias("flag_rate"), "earliness_frac", "earliness_step")


def auc_roc(scored: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by middle ranks, from counts of equal scores."""
    by = scored.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2
    c = running_sums(by, (score,), ("_n",), keys).groupBy(*keys).agg(F.sum(rank * F.col("_p")).alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return c.select(*keys, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc_roc"))


def auc_pr(scored: DataFrame, score: str = "score", label: str = "label", tie: str = "run_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Average precision in the order of falling score; ties in the order of `tie`."""
    rows = scored.select(*keys, (-F.col(score)).alias("_fall"), F.col(tie).alias("_tie"), F.col(label).cast("long").alias("_hit"), F.lit(1).cast("long").alias("_one"))
    placed = running_sums(rows, ("_fall", "_tie"), ("_hit", "_one"), keys)
    precision = (F.col("_hit_before") + 1) / (F.col("_one_before") + 1)
    return placed.groupBy(*keys).agg((F.sum(F.when(F.col("_hit") == 1, precision)) / F.nullif(F.sum("_hit"), F.lit(0))).alias("auc_pr"))


def mean_std(values: DataFrame, col: str, *keys: str) -> DataFrame:
    """Mean and deviation (n - 1) over repetitions, without nulls and NaN; 0 for a single one."""
    v = F.when(~F.isnan(F.col(col).cast("double")), F.col(col))
    return values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"))


def over_seeds(cells: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS, seed: str = "seed") -> DataFrame:
    """keys and, of each metric, a struct (mean, std, raw): over seeds without nulls and NaN, and the values in the order of seeds."""
    made = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        raw = F.transform(F.array_sort(F.collect_list(F.struct(seed, v.alias("v")))), lambda x: x["v"])
        made.append(F.struct(F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), raw.alias("raw")).alias(m))
    return cells.groupBy(*keys).agg(*made)


def failure_rate(traces: DataFrame, *keys: str) -> DataFrame:
    return traces.groupBy(*keys).agg(F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("failure_rate"))


def corpus_summary(events: DataFrame) -> DataFrame:
    """Runs, tasks, successes, failures, failure rate, alphabet, upper-median lengths.

    A median is read off the counts of the lengths that occur.
    """
    runs = events.groupBy("run_id").agg(F.count("*").alias("n"), F.first("success").alias("success"), F.first("task_id").alias("task_id"))
    sizes = F.array(*[F.struct(F.lit(w).alias("which"), when.alias("keep")) for w, when in ((0, F.lit(True)), (1, F.col("success")), (2, ~F.col("success")))])
    counted = runs.select("n", F.inline(sizes)).filter("keep").groupBy("which", "n").agg(F.count("*").alias("c"))
    upto = counted.select("which", "n", F.sum("c").over(W.partitionBy("which").orderBy("n")).alias("upto"), F.sum("c").over(W.partitionBy("which")).alias("all"))
    at = lambda w: F.min(F.when((F.col("which") == w) & (F.col("upto") > F.floor(F.col("all") / 2)), F.col("n")))
    medians = upto.agg(at(0).alias("length"), at(1).alias("length_success"), at(2).alias("length_failure"))
    labels = events.agg(F.count_distinct("act").alias("alphabet"))
    return runs.agg(
        F.count("*").alias("runs"), F.count_distinct("task_id").alias("tasks"), F.sum(F.col("success").cast("int")).alias("successes"), F.sum((~F.col("success")).cast("int")).alias("failures"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("failure_rate"),
    ).crossJoin(medians).crossJoin(labels)  # one row each


def per_environment(cells: DataFrame) -> DataFrame:
    """Mean over settings by detector and environment: no F1 counts as 0, no earliness is left out."""
    return cells.groupBy("detector", "environment").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"), F.avg("earliness_frac").alias("earliness_frac"), F.avg("flag_rate").alias("flag_rate"))


def summarise(per_env: DataFrame, col: str = "f1", *keys: str) -> DataFrame:
    """Mean and standard error over environments."""
    return per_env.groupBy("detector", *keys).agg(F.avg(col).alias("mean"), F.when(F.count(col) > 0, F.coalesce(F.stddev_samp(col), F.lit(0.0)) / F.sqrt(F.count(col).cast("double"))).alias("sem"))


def best_setting(cells: DataFrame) -> DataFrame:
    """The setting (k, q) of the highest mean F1 by detector; the first of equals."""
    m = cells.groupBy("detector", "k", "q").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"))
    by = W.partitionBy("detector").orderBy(F.desc(F.round("f1", 9)), "k", "q")
    return m.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def ranking(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("mean"), "detector")


def nested_results(cells: DataFrame, *keys: str) -> DataFrame:
    """One row for each key with its cells as an array, for a nested result file."""
    rest = [c for c in cells.columns if c not in keys]
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("cells"))
