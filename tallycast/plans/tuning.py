"""Hyper-parameter trials scored by rolling origin, with median pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.operators.metrics import scored

# Pruning starts after this many trials and steps.
STARTUP_TRIALS = 5
WARMUP_STEPS = 3


def month_losses(results: DataFrame, trial: int) -> DataFrame:
    """Sum of absolute errors per issue month of one trial; the step is the month's rank."""
    per = scored(results).groupBy(F.trunc("issue_date", "month").alias("month")).agg(
        F.sum(F.abs("error")).alias("loss"), F.count(F.lit(1)).alias("n"))
    step = F.row_number().over(Window.orderBy("month")) - 1  # one row per month
    return per.select(F.lit(trial).cast("bigint").alias("trial"), step.cast("bigint").alias("step"), "loss", "n")


def running_mae(losses: DataFrame) -> DataFrame:
    """MAE over all months up to each step, per trial, and its best value so far."""
    w = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = losses.withColumn("running", F.sum("loss").over(w) / F.sum("n").over(w))
    return run.withColumn("best_so_far", F.min("running").over(w))


def median_rule(running: DataFrame, startup: int = STARTUP_TRIALS, warmup: int = WARMUP_STEPS) -> DataFrame:
    """Would the median rule stop a trial at a step?

    A trial is stopped when its best running MAE so far is worse than the median of the
    *earlier* trials' running MAE at the same step. Trials per step are a handful, so
    the window over a step is small.
    """
    earlier = Window.partitionBy("step").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    med = F.percentile("running", F.lit(0.5)).over(earlier)
    seen = F.count("running").over(earlier)
    return running.withColumn("earlier_median", med).withColumn(
        "would_prune", (seen >= startup) & (F.col("step") >= warmup) & (F.col("best_so_far") > F.col("earlier_median")))


def apply_pruning(running: DataFrame, startup: int = STARTUP_TRIALS, warmup: int = WARMUP_STEPS) -> DataFrame:
    """Trial table with the sequential rule: a pruned trial reports nothing after its stop.

    Later medians only see the steps a trial really reported, so trials are decided in
    order; the state is the list of reported steps, a few numbers per trial.
    """
    steps = running.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("step", "running"))).alias("s")).orderBy("trial").collect()
    reported: dict[int, list[float]] = {}
    out = []
    for row in steps:  # one short list per trial: bounded by trials x months
        best, state, last = float("inf"), "COMPLETE", None
        done = [x for x in out if x]
        for cell in row["s"]:
            best, last = min(best, cell["running"]), cell
            others = sorted(reported.get(cell["step"], []))
            reported.setdefault(cell["step"], []).append(cell["running"])
            if len(done) >= startup and cell["step"] >= warmup and others:
                k = len(others)
                med = others[k // 2] if k % 2 else (others[k // 2 - 1] + others[k // 2]) / 2
                if best > med:
                    state = "PRUNED"
                    break
        out.append((row["trial"], state, float(last["running"]), int(last["step"]) + 1))
    return running.sparkSession.createDataFrame(out, "trial bigint, state string, value double, n_steps bigint")


def run_trials(results: Sequence[DataFrame]) -> DataFrame:
    """Running MAE of every trial's prediction rows; trial 0 holds the defaults."""
    parts = [month_losses(r, i) for i, r in enumerate(results)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return running_mae(out)


def trial_log(model: str, trials: Sequence[Mapping[str, float]], pruned: DataFrame) -> DataFrame:
    """Trial table with parameters as canonical JSON."""
    spark = pruned.sparkSession
    import json

    params = spark.createDataFrame([(i, json.dumps(dict(p), sort_keys=True)) for i, p in enumerate(trials)], "trial bigint, params string")
    return pruned.join(F.broadcast(params), "trial").select(F.lit(model).alias("model"), F.col("trial").alias("number"), "state", "value", "n_steps", "params")


def best_trial(log: DataFrame) -> DataFrame:
    """Lowest MAE among completed trials; ties go to the earlier trial."""
    done = log.where("state = 'COMPLETE'")
    return done.groupBy("model").agg(F.min_by(F.struct("number", "value", "params"), F.struct("value", "number")).alias("b")).select("model", "b.*")
