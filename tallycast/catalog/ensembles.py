"""Ensemble queries (C11, K1-K6, J8 with a plain-mean base, K10 pruning on stored scores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import LINE_PANEL, ORDER_PANEL, SCORED, SCORED_SQL, VALIDATION, line_panel, order_panel, results_ctes, roll, staged, table
from tallycast.operators import ensemble as E
from tallycast.operators import metrics as M
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import DAILY

START, END = VALIDATION
S_START, S_END = SCORED
MEMBERS = ("plain_28d", "same_wd_4w", "same_wd_13w", "same_wd_26w")
_RES = results_ctes(LINE_PANEL, DAILY, START, END, (4, 13, 26))
_WIDE = (f"{_RES}, wp as (select spec, issue_date, cutoff, target_start, target_end, grp, y_true, " + ", ".join(f"max(y_pred) filter (where model = '{m}') as {m}" for m in MEMBERS)
         + " from results group by all)")


def wide(spark, sf):
    return E.wide_predictions(rolling_origin(line_panel(spark, sf), DAILY, START, END, (4, 13, 26)), MEMBERS)


@query("c11_wide_predictions", f"with {_WIDE} select * from wp")
def c11(spark, sf):
    return wide(spark, sf)


@query("c11_alignment_audit", f"with {_RES}, k as (select spec, issue_date, grp, count(*) as rows, count(distinct model) as models, (min(y_true) is not distinct from max(y_true)) and count(y_true) in (0, count(*)) as one, count(*) filter (where y_true is not null and y_pred is null) as nulls from results group by 1, 2, 3) "
       "select count(*) as keys, count(distinct spec) as specs, count(*) filter (where models <> 4) as incomplete_keys, count(*) filter (where rows <> models) as repeated_keys, count(*) filter (where not one) as conflicting_truth, cast(sum(nulls) as bigint) as null_forecasts from k")
def c11a(spark, sf):
    return E.alignment_audit(rolling_origin(line_panel(spark, sf), DAILY, START, END, (4, 13, 26)), MEMBERS)


_A, _B, _C, _D = MEMBERS
_SCORED_W = f"{_WIDE}, sw as (select * from wp where target_start >= date '{S_START}' and target_end <= date '{S_END}')"
_MEAN = f"({_A} + {_B} + {_C} + {_D}) / 4.0"
_MED = f"case when {_A} + {_B} + {_C} + {_D} is not null then (list_sort(list_value({_A}, {_B}, {_C}, {_D}))[2] + list_sort(list_value({_A}, {_B}, {_C}, {_D}))[3]) / 2 end"


@query("k01_combine_mean_median", f"with {_SCORED_W} select spec, issue_date, cutoff, target_start, target_end, grp, y_true, 'ens_mean' as model, {_MEAN} as y_pred from sw union all select spec, issue_date, cutoff, target_start, target_end, grp, y_true, 'ens_median', {_MED} from sw")
def k01(spark, sf):
    return E.combine_rows(wide(spark, sf), MEMBERS, S_START, S_END)


_FIXED = {_A: 3.0, _B: 1.0, _C: 0.0, _D: 1.0}


@query("k01_combine_weighted", f"with {_SCORED_W} select issue_date, grp, {_A} * 0.6 + {_B} * 0.2 + {_C} * 0.0 + {_D} * 0.2 as y_pred from sw")
def k01w(spark, sf):
    w = {k: F.lit(v) for k, v in E.scaled_weights(MEMBERS, _FIXED).items()}
    s = wide(spark, sf).where((F.col("target_start") >= F.lit(S_START).cast("date")) & (F.col("target_end") <= F.lit(S_END).cast("date")))
    return s.select("issue_date", "grp", E.combine_weighted(MEMBERS, w).alias("y_pred"))


@query("k02_weight_check", "with w as (select c_nationkey as \"set\", c_mktsegment as member, sum(c_acctbal) as weight from customer group by 1, 2), "
       "k as (select *, count(*) filter (where member not in ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')) over (partition by \"set\") as unk, count(*) over (partition by \"set\") as c, min(weight) over (partition by \"set\") as lo, sum(weight) over (partition by \"set\") as s from w) "
       "select \"set\", member, weight, unk = 0 and c = 5 and lo >= 0 and s > 0 as valid, case when unk = 0 and c = 5 and lo >= 0 and s > 0 then weight / s end as scaled from k")
def k02(spark, sf):
    """Weight sets taken from customer balances per nation; some sets are invalid by design."""
    w = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("set"), F.col("c_mktsegment").alias("member")).agg(F.sum("c_acctbal").alias("weight"))
    return E.weight_table(w, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


_STEPS = 10
_LATTICE = (f"ra as (select cast(unnest(generate_series(0, {_STEPS})) as integer) as k), lat as (select row_number() over (order by a.k, b.k, c.k) - 1 as vec, a.k / {_STEPS}.0 as wa, b.k / {_STEPS}.0 as wb, c.k / {_STEPS}.0 as wc, ({_STEPS} - a.k - b.k - c.k) / {_STEPS}.0 as wd "
            f"from ra a, ra b, ra c where a.k + b.k + c.k <= {_STEPS})")
_K03 = (f"{_WIDE}, {_LATTICE}, mo as (select date_trunc('month', issue_date) as month, min(issue_date) as issue_date, min(issue_date) - 2 as cutoff from wp group by 1 having count(*) filter (where target_start >= date '{S_START}' and target_end <= date '{S_END}') > 0), "
        f"tr as (select mo.month, vec, sum(abs(cast({_A} as double) * cast(wa as double) + {_B} * cast(wb as double) + {_C} * cast(wc as double) + {_D} * cast(wd as double) - y_true)) as loss, count(*) as n_rows from mo join wp on wp.target_end <= mo.cutoff and y_true is not null and {_A} + {_B} + {_C} + {_D} is not null cross join lat group by 1, 2), "
        "be as (select month, arg_min(vec, {'l': round(loss, 6), 'v': vec}) as vec, min(loss) / max(n_rows) as train_mae, max(n_rows) as n_rows from tr group by month), "
        f"fit as (select cast(mo.month as date) as month, mo.issue_date, mo.cutoff, n_rows, train_mae, cast(wa as double) as w_{_A}, cast(wb as double) as w_{_B}, cast(wc as double) as w_{_C}, cast(wd as double) as w_{_D} from mo join be on be.month = mo.month join lat on lat.vec = be.vec)")


def weights(spark, sf):
    return E.rolling_weights(wide(spark, sf), MEMBERS, DAILY.publication_lag_days, S_START, S_END, _STEPS)


@query("k03_rolling_weights", f"with {_K03} select * from fit")
def k03(spark, sf):
    return weights(spark, sf)


@query("k04_combine_out_of_fold", f"with {_K03}, sw as (select * from wp where target_start >= date '{S_START}' and target_end <= date '{S_END}'), "
       f"e as (select issue_date, grp, y_true, 'ens_mean' as model, {_MEAN} as y_pred from sw union all select issue_date, grp, y_true, 'ens_median', {_MED} from sw union all "
       f"select sw.issue_date, grp, y_true, 'ens_weighted', {_A} * w_{_A} + {_B} * w_{_B} + {_C} * w_{_C} + {_D} * w_{_D} from sw left join fit on fit.month = date_trunc('month', sw.issue_date)) select * from e")
def k04(spark, sf):
    w = wide(spark, sf)
    fits = E.rolling_weights(w, MEMBERS, DAILY.publication_lag_days, S_START, S_END, _STEPS)
    return E.combine_rows(w, MEMBERS, S_START, S_END, fits).select("issue_date", "grp", "y_true", "model", "y_pred")


@query("k05_weight_summary", f"with {_K03} " + " union all ".join(f"select '{m}' as member, avg(w_{m}) as mean, min(w_{m}) as min, max(w_{m}) as max from fit" for m in MEMBERS))
def k05(spark, sf):
    return E.weight_summary(weights(spark, sf), MEMBERS)


_FINE = (f"fw as (select month, cutoff, [{', '.join(f'w_{m}' for m in MEMBERS)}] as ws from fit), ix as (select cast(unnest(range(1, 5)) as integer) as i), st as (select cast(unnest(range(1, 6)) as integer) as k), "
         "nb as (select month, cutoff, 0 as ord, ws from fw union all select month, cutoff, a.i * 100 + b.i * 10 + k, "
         "list_transform(ws, lambda w, x: least(1.0, greatest(0.0, w + case when x = a.i then k / 100.0 when x = b.i then -k / 100.0 else 0.0 end))) from fw, ix a, ix b, st where a.i <> b.i and ws[b.i] - k / 100.0 >= -1e-12), "
         f"tn as (select nb.month, ord, any_value(ws) as ws, sum(abs({_A} * ws[1] + {_B} * ws[2] + {_C} * ws[3] + {_D} * ws[4] - y_true)) as loss, count(*) as n from nb join wp on wp.target_end <= nb.cutoff and y_true is not null and {_A} + {_B} + {_C} + {_D} is not null group by 1, 2), "
         "bn as (select month, arg_min(ws, {'l': round(loss, 6), 'v': ord}) as ws, min(loss) / max(n) as train_mae from tn group by month)")


@query("k03_refined_weights", f"with {_K03}, {_FINE} select month, train_mae, " + ", ".join(f"ws[{i + 1}] as w_{m}" for i, m in enumerate(MEMBERS)) + " from bn")
def k03r(spark, sf):
    """One finer lattice around each month's best vector."""
    w = wide(spark, sf)
    fits = E.rolling_weights(w, MEMBERS, DAILY.publication_lag_days, S_START, S_END, _STEPS)
    return E.refine_weights(w, MEMBERS, fits)


@query("k06_equal_weight_checked", f"with {_WIDE} select issue_date, grp, y_true, ({_A} + {_C}) / 2.0 as y_pred from wp where {_A} is not null and {_C} is not null and y_true is not null")
def k06(spark, sf):
    """Equal-weight mean through a validated one-to-one join of two members."""
    from tallycast.operators.joins import validated_join

    r = rolling_origin(line_panel(spark, sf), DAILY, START, END, (4, 13, 26)).where("y_true is not null and y_pred is not null")
    a, c = (r.where(F.col("model") == m).select("issue_date", "grp", "y_true", F.col("y_pred").alias(m)) for m in (_A, _C))
    j = validated_join(a, c.withColumnRenamed("y_true", "y_check"), ["issue_date", "grp"], "one_to_one").where("y_true = y_check")
    return j.select("issue_date", "grp", "y_true", E.combine_mean([_A, _C]).alias("y_pred"))


_TOP = (f"{ORDER_PANEL}, tot as (select date, cast(0 as bigint) as grp, case when count(n) = (select count(distinct grp) from panel) then cast(sum(n) as bigint) end as n from panel group by date), "
        f"base as (select date as cutoff, {roll('avg', 'n', 28, 20)} as total from tot), ok as (select date, count(n) = (select count(distinct grp) from panel) as ok from panel group by date), "
        "m as (select panel.date, grp, case when ok then n end as n from panel join ok on ok.date = panel.date), s as (select date, grp, sum(n) over w as s, count(n) over w as k from m window w as (partition by grp order by date rows between 27 preceding and current row)), "
        "t as (select date, sum(s) as t from s group by date), shr as (select s.date as cutoff, grp, case when k >= 20 then cast(s as double) / nullif(t, 0) end as share from s join t on t.date = s.date)")


@query("j08_top_down", f"with {_TOP} select shr.cutoff + 2 as issue_date, shr.cutoff, shr.grp, share * total as y_pred from shr join base on base.cutoff = shr.cutoff")
def j08(spark, sf):
    from tallycast.models.topdown import top_down_plain

    return top_down_plain(staged(order_panel(spark, sf)), DAILY, n_groups=5).select("issue_date", "cutoff", "grp", "y_pred")


# Trial scores: each supplier nation acts as a trial, each year as a step.
_TRIALS = ("sc as (select cast(s_nationkey as bigint) as trial, cast(year(l_shipdate) - 1995 as bigint) as step, sum(l_quantity) as loss, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2), "
           "rn as (select trial, step, sum(loss) over w / sum(n) over w as running from sc window w as (partition by trial order by step)), "
           "bs as (select *, min(running) over (partition by trial order by step) as best_so_far from rn), "
           "pr as (select a.trial, a.step, a.running, a.best_so_far, (select median(b.running) from rn b where b.step = a.step and b.trial < a.trial) as med, (select count(*) from rn b where b.step = a.step and b.trial < a.trial) as seen from bs a)")


@query("k10_running_mae_prune", f"with {_TRIALS} select trial, step, running, med as earlier_median, seen >= 5 and step >= 3 and best_so_far > med as would_prune from pr")
def k10(spark, sf):
    from tallycast.plans.tuning import median_rule, running_mae

    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    losses = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").cast("bigint").alias("trial"), (F.year("l_shipdate") - 1995).cast("bigint").alias("step")).agg(
        F.sum("l_quantity").alias("loss"), F.count(F.lit(1)).alias("n"))
    return median_rule(running_mae(losses), 5, 3).select("trial", "step", "running", "earlier_median", "would_prune")
