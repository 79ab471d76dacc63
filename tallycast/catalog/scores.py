"""Score, spread and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import BREAK_DATE, LINE_PANEL, ORDER_PANEL, SCORED_SQL, TEST_END, TEST_START, VALIDATION, line_panel, order_panel, results_ctes
from tallycast.catalog.joins import _CAL, anomaly_calendar
from tallycast.functions.stats import rolling
from tallycast.operators import ensemble as E
from tallycast.operators import metrics as M
from tallycast.operators.joins import flag_windows
from tallycast.operators.profile import append_all
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import DAILY, WEEKLY, Setting

START, END = VALIDATION
_RES = f"{results_ctes(LINE_PANEL, DAILY, START, END)}, {SCORED_SQL}"
_COLS = "count(*) as n, avg(abs(error)) as mae, avg(error) as bias, median(error) as median_error, avg(cast(error < 0 as double)) as under_share"


def results(spark, sf):
    return rolling_origin(line_panel(spark, sf), DAILY, START, END)


@query("l01_score_overall", f"with {_RES} select model, {_COLS} from sc group by model")
def l01(spark, sf):
    return M.score(results(spark, sf))


@query("l01_score_by_month", f"with {_RES} select model, month, {_COLS} from sc group by model, month")
def l01m(spark, sf):
    return M.score(results(spark, sf), ["month"])


@query("l02_error_spread", f"with {_RES} select model, grp, count(*) as n, avg(error) as bias, var_pop(error) as error_var, stddev_pop(error) as error_sd from sc group by model, grp")
def l02(spark, sf):
    return M.error_spread(results(spark, sf), ["grp"])


@query("l03_error_sd_sample", f"with {_RES} select model, count(*) as n, avg(error) as bias, var_samp(error) as error_var, stddev_samp(error) as error_sd from sc group by model")
def l03(spark, sf):
    return M.error_spread(results(spark, sf), ddof=1)


@query("l04_wape", f"with {_RES} select model, sum(abs(error)) / nullif(sum(y_true), 0) as wape from sc group by model")
def l04(spark, sf):
    return M.wape(results(spark, sf))


@query("l05_improvement", f"with {_RES}, t as (select model, avg(abs(error)) as mae, avg(error) as bias from sc group by model), r as (select mae as ref from t where model = 'same_wd_13w') select model, mae, bias, abs(bias) as absolute_bias, (ref - mae) / ref * 100 as mae_improvement_pct from t, r")
def l05(spark, sf):
    return M.improvement(results(spark, sf), "same_wd_13w")


_ORD = f"{results_ctes(ORDER_PANEL, DAILY, START, END, (4, 13))}, {_CAL}, sc as (select r.*, y_pred - y_true as error, cast(month(target_start) as bigint) as month, cast(year(target_start) as bigint) as year, coalesce(a.anomaly, false) as anomaly from results r left join acal a on a.grp = r.grp and a.date = r.target_start where y_true is not null)"


@query("l06_score_sets", f"with {_ORD} select model, grp, year, month, cast(grouping(model)*8 + grouping(grp)*4 + grouping(year)*2 + grouping(month) as bigint) as gid, count(*) as n, avg(abs(error)) as mae, avg(error) as bias, count(*) filter (where not anomaly) as n_clean, "
       "avg(abs(error)) filter (where not anomaly) as mae_clean, avg(error) filter (where not anomaly) as bias_clean from sc group by grouping sets ((model), (model, grp), (model, year), (model, month))")
def l06(spark, sf):
    r = flag_windows(rolling_origin(order_panel(spark, sf), DAILY, START, END, (4, 13)), anomaly_calendar(spark, sf))
    return M.score_sets(r, [[], ["grp"], ["year"], ["month"]])


def _boot_sql(ctes, model, ref, n_boot, seed=42):
    return (f"with {ctes}, pr as (select issue_date, grp, target_start, max(abs(error)) filter (where model = '{model}') as em, max(abs(error)) filter (where model = '{ref}') as er from sc group by 1, 2, 3), "
            "wk as (select isoyear(target_start) * 100 + weekofyear(target_start) as week, sum(em) as sm, sum(er) as sr, count(*) as c from pr where em is not null and er is not null group by 1), "
            "bl as (select *, row_number() over (order by week) - 1 as idx from wk), nb as (select count(*) as k from wk), "
            f"dr as (select rep, cast('0x' || substr(md5('{seed}-' || rep || '-' || slot), 1, 8) as bigint) % k as idx from nb, (select unnest(generate_series(0, {n_boot - 1})) as rep) a, lateral (select unnest(generate_series(0, k - 1)) as slot) b), "
            "bo as (select rep, (sum(sm) - sum(sr)) / sum(c) as d from dr join bl on bl.idx = dr.idx group by rep) "
            f"select '{model}' as model, '{ref}' as reference, sum(sm) / sum(c) as mae_model, sum(sr) / sum(c) as mae_reference, sum(sm) / sum(c) - sum(sr) / sum(c) as diff, (select quantile_cont(d, 0.025) from bo) as ci_low, (select quantile_cont(d, 0.975) from bo) as ci_high, count(*) as n_blocks from wk")


@query("l07_paired_bootstrap", _boot_sql(_RES, "plain_28d", "same_wd_13w", 2000))
def l07(spark, sf):
    return M.paired_bootstrap(results(spark, sf), "plain_28d", "same_wd_13w")


@query("l08_monthly_winners", f"with {_RES}, m as (select date_trunc('month', target_start) as ym, " + ", ".join(f"avg(abs(error)) filter (where model = '{x}') as {x}" for x in ("plain_28d", "same_wd_4w", "same_wd_13w")) + " from sc group by 1) "
       + " union all ".join(f"select '{x}' as model, count(*) filter (where {x} = least(plain_28d, same_wd_4w, same_wd_13w)) as months_won from m" for x in ("plain_28d", "same_wd_4w", "same_wd_13w")))
def l08(spark, sf):
    return M.monthly_winners(results(spark, sf), ["plain_28d", "same_wd_4w", "same_wd_13w"])


@query("g01_select_window", f"with {_RES}, t as (select model, avg(abs(error)) as mae from sc where model like 'same_wd_%' group by model) select arg_min(model, {{'m': mae, 'l': cast(regexp_extract(model, '(\\d+)', 1) as bigint)}}) as model, min(mae) as mae from t")
def g01(spark, sf):
    return M.select_window(results(spark, sf))


@query("g01_best_by_group", f"with {_RES}, t as (select model, grp, avg(abs(error)) as mae from sc group by model, grp) select grp, arg_min(model, {{'m': mae, 'n': model}}) as model, min(mae) as mae from t group by grp")
def g01b(spark, sf):
    t = M.scored(results(spark, sf)).groupBy("model", "grp").agg(F.avg(F.abs("error")).alias("mae"))
    return M.best_model(t, ["grp"])


@query("e15_smoothed_actual_forecast", f"with {_RES}, d as (select model, target_start as date, sum(y_true) as actual, sum(y_pred) as forecast from sc group by 1, 2) select model, date, case when count(actual) over w >= 7 then avg(actual) over w end as actual_7d, case when count(forecast) over w >= 7 then avg(forecast) over w end as forecast_7d from d window w as (partition by model order by date rows between 6 preceding and current row)")
def e15(spark, sf):
    d = M.scored(results(spark, sf)).groupBy("model", F.col("target_start").alias("date")).agg(F.sum("y_true").alias("actual"), F.sum("y_pred").alias("forecast"))
    w = Window.partitionBy("model").orderBy("date")
    return d.select("model", "date", *(rolling(F.avg, F.col(c), w, 7, 7).alias(f"{c}_7d") for c in ("actual", "forecast")))


_TEST = f"{results_ctes(LINE_PANEL, DAILY, TEST_START, TEST_END, (13,))}, {SCORED_SQL}"


def test_results(spark, sf):
    return rolling_origin(line_panel(spark, sf), DAILY, TEST_START, TEST_END, (13,), test_start=TEST_START, allow_test=True)


@query("k07_break_periods", f"with {_TEST}, p as (select *, case when target_start < date '{BREAK_DATE}' then 'before_break' else 'after_break' end as period, strftime(target_start, '%Y-%m') as year_month from sc) "
       f"select model, period, {_COLS} from p group by model, period union all select model, year_month, {_COLS} from p group by model, year_month")
def k07(spark, sf):
    r = E.with_period(test_results(spark, sf), BREAK_DATE)
    return M.score(r, ["period"]).unionByName(M.score(r, ["year_month"]).withColumnRenamed("year_month", "period"))


@query("k08_break_bootstrap", " union all ".join(
    f"(select '{p}' as period, q.* from ({_boot_sql(_TEST.replace('where y_true is not null', f'where y_true is not null and target_start {op} date {chr(39)}{BREAK_DATE}{chr(39)}'), 'plain_28d', 'same_wd_13w', 2000)}) q)"
    for p, op in (("before_break", "<"), ("after_break", ">="))))
def k08b(spark, sf):
    r = E.with_period(test_results(spark, sf), BREAK_DATE)
    return append_all([
        M.paired_bootstrap(r.where(F.col("period") == p), "plain_28d", "same_wd_13w", 2000).select(F.lit(p).alias("period"), "*")
        for p in (E.BEFORE, E.AFTER)])


_SETTINGS = (DAILY, WEEKLY, Setting(lead_days=7))


def _k09_part(s):
    return f"(with {results_ctes(LINE_PANEL, s, START, END, (13,))}, {SCORED_SQL} select '{s.key}' as spec, model, count(*) as n, avg(abs(error)) as mae, avg(error) as bias, sum(abs(error)) / nullif(sum(y_true), 0) as wape from sc group by model)"


@query("k09_horizon_comparison", " union all ".join(_k09_part(s) for s in _SETTINGS))
def k09(spark, sf):
    from tallycast.plans.horizons import horizon_scores

    return horizon_scores(line_panel(spark, sf), _SETTINGS, START, END, (13,))
