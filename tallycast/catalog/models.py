"""Fitted models, holdout, live forecast and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import BREAK_DATE, LINE_KEEP, LINE_PANEL, ORDER_PANEL, SUPP_PANEL, TEST_END, TEST_START, VALIDATION, feature_ctes, line_panel, months_between, order_panel, results_ctes, roll, same_weekday_sql, staged, supplier_panel
from tallycast.functions.stats import rolling
from tallycast.models import learners as L
from tallycast.models import linear, negbin, smoothing
from tallycast.models.boosting import boosted_backtest
from tallycast.models.topdown import SHARE_DAYS
from tallycast.operators import features as X
from tallycast.operators import metrics as M
from tallycast.operators.ensemble import AFTER, BEFORE
from tallycast.plans import holdout as H
from tallycast.plans import tuning as T
from tallycast.plans.registry import registry_run
from tallycast.sources.sinks import stage
from tallycast.spec import DAILY, WEEKLY, min_samples

SPAN = VALIDATION
MONTHS = months_between(*VALIDATION)


def line_features(spark, sf):
    """Feature table written once; every refit month reads it back pruned."""
    return stage(X.feature_table(line_panel(spark, sf), DAILY), "features")


# Boosted queries take fewer and larger steps than the registry's 400 at 0.05; README has figures for both.
QUERY_TREES, QUERY_RATE = 100, 0.2


def checked(rows, features, slack=1.1):
    """Keys and truth of prediction rows, whether they have a forecast, and whether their model's MAE is at most `slack` times the plain mean's.

    Forecasts themselves have no SQL form; keys, truth, gaps and the bound on the error do.
    """
    plain = features.select("issue_date", F.col("grp").alias("g"), F.col("mean_28d").alias("plain"))
    met = rows.join(plain.withColumnRenamed("issue_date", "d"), (F.col("issue_date") == F.col("d")) & (F.col("grp") == F.col("g")), "left")
    met = stage(met, "checked")
    both = met.where("y_true is not null and y_pred is not null and plain is not null")
    mae = [F.avg(F.abs(F.col(c) - F.col("y_true"))) for c in ("y_pred", "plain")]
    bound = both.groupBy("model").agg((mae[0] <= slack * mae[1]).alias("no_worse"))  # one row a model
    return met.join(F.broadcast(bound), "model", "left").select(
        "model", "issue_date", "cutoff", "target_start", "target_end", "grp", "y_true", F.col("y_pred").isNotNull().alias("predicted"), "no_worse")


def checked_sql(names, needs_level, all_rows=True):
    """SQL twin of checked rows: every issue date of the validation months, forecasts wherever the level allows one."""
    made = "coalesce(mean_28d > 0, false)" if needs_level else "true"
    models = ", ".join(f"('{n}')" for n in names)
    return (f"with {feature_ctes(LINE_PANEL, DAILY)} select model, issue_date, cutoff, target_start, target_start as target_end, grp, y as y_true, {made} as predicted, true as no_worse "
            f"from feat cross join (values {models}) v(model) where issue_date between date '{VALIDATION[0]}' and date '{VALIDATION[1]}'" + ("" if all_rows else f" and {made}"))


def boosted(names):
    def run(spark, sf):
        features = line_features(spark, sf)
        models = [L.boosted_model(c, {"rate": QUERY_RATE}) for c in L.select_configs(names)]
        return checked(boosted_backtest(features, models, DAILY, MONTHS, QUERY_TREES, L.DEPTH), features)

    return run


_STRICT = (f"with {LINE_PANEL} select cast(date_trunc('month', date) as date) as refit_month, date, grp, cast(n as double) as y_true, true as predicted, true as no_worse "
           f"from panel where n is not null and date between date '{VALIDATION[0]}' and date '{VALIDATION[1]}'")


@query("j01_linear_monthly", _STRICT)
def j01(spark, sf):
    panel = staged(line_panel(spark, sf))
    rows = linear.monthly_linear(X.strict_features(panel), LINE_KEEP, *SPAN).withColumns({"model": F.lit("linear"), "issue_date": F.date_sub("date", 1)})
    rows = rows.withColumns({"cutoff": F.col("date"), "target_start": F.col("date"), "target_end": F.col("date")})
    plain = panel.select(DAILY.issue_of_cutoff(F.col("date")).alias("issue_date"), "grp", rolling(F.avg, F.col("n"), X.series(), 28, min_samples(28)).alias("mean_28d"))
    done = checked(rows, plain)
    return done.select(F.trunc("target_start", "month").alias("refit_month"), F.col("target_start").alias("date"), "grp", "y_true", "predicted", "no_worse")


OFFSETS = ("gbt_poisson", "gbt_tweedie", "sym_poisson", "sym_tweedie")
for _q, _names, _level in (("j02_boosted_l2_raw", ["gbt_l2_raw"], False), ("j02_boosted_l1_raw", ["gbt_l1_raw"], False),
                           ("j03_boosted_ratio", ["gbt_l1"], True), ("j04_boosted_offsets", OFFSETS, True)):
    query(_q, checked_sql(_names, _level))(boosted(_names))


def _glm(name):
    def run(spark, sf):
        features = line_features(spark, sf)
        return checked(L.monthly_backtest(features, L.select_configs([name])[0], DAILY, MONTHS), features)

    return run


for _q, _m in (("j04_poisson_offset", "glm_poisson"), ("j04_tweedie_offset", "glm_tweedie")):
    query(_q, checked_sql([_m], True, all_rows=False))(_glm(_m))


@query("j05_negative_binomial")
def j05(spark, sf):
    return negbin.monthly_backtest(line_features(spark, sf), LINE_KEEP, DAILY, MONTHS)


def _state_ctes(panel: str, issues: str, s, tag: str = "") -> str:
    """CTEs ending in ``ets``: the states of every parameter pair as a recursion over the days, the best pair at each month's refit."""
    lag, gap, width = s.publication_lag_days, s.gap_days, s.window_days
    grid = ", ".join(f"({i}, {a}::double, {g}::double)" for i, (a, g) in enumerate(smoothing.GRID))
    weekly = ", ".join(f"avg(y) filter (where t % 7 = {k}) - avg(y)" for k in range(7))
    path = " + ".join(f"exp(o.level + o.season[(i.cutoff - i.a + {gap + j}) % 7 + 1])" for j in range(width))
    so_far, ahead = (f"over (partition by grp order by t rows between {f})" for f in ("unbounded preceding and current row", "current row and unbounded following"))
    bo, lg, nb, ys, pr, fo, iw, ip, ok, bp, ets = (f"{n}{tag}" for n in ("bo", "lg", "nb", "ys", "pr", "fo", "iw", "ip", "ok", "bp", "ets"))
    return (
        f"{bo} as (select grp, min(date) as a, max(date) as z from {panel} where n > 0 group by grp), "
        f"{lg} as (select p.grp, cast(date - a as bigint) as t, case when n > 0 then ln(n) end as v from {panel} p join {bo} b on b.grp = p.grp and date between a and z), "
        f"{nb} as (select grp, t, v, last_value(v ignore nulls) {so_far} as pv, max(case when v is not null then t end) {so_far} as pt, first_value(v ignore nulls) {ahead} as qv, "
        f"min(case when v is not null then t end) {ahead} as qt, count(v) {so_far} as cnt from {lg}), "
        f"{ys} as materialized (select grp, t, coalesce(v, pv + (qv - pv) / cast(qt - pt as double) * (t - pt)) as y, pt, cnt from {nb}), "
        f"{pr}(gi, al, ga) as (values {grid}), "
        f"{fo} as (select grp, gi, al, ga, cast(-1 as bigint) as t, level, season, 0.0::double as sse from (select grp, avg(y) as level, [{weekly}] as season from {ys} where t < 14 group by grp having count(*) = 14), {pr} "
        "union all select grp, gi, al, ga, t, level + al * e, list_transform(season, lambda x, k: case when k = t % 7 + 1 then x + ga * e else x end), sse + e * e "
        f"from (select f.grp, gi, al, ga, y.t, level, season, sse, y - level - season[y.t % 7 + 1] as e from {fo} f join {ys} y on y.grp = f.grp and y.t = f.t + 1)), "
        f"{iw} as (select r.grp, issue_date, cutoff, a, min(issue_date) over (partition by r.grp, date_trunc('month', issue_date)) - {lag} as refit, cast(z - a as bigint) as top from ({issues}) r left join {bo} b on b.grp = r.grp), "
        f"{ip} as (select i.*, f.pt as fit_at, f.cnt as seen, w.pt as now_at from {iw} i left join {ys} f on f.grp = i.grp and f.t = least(cast(refit - a as bigint), top) left join {ys} w on w.grp = i.grp and w.t = least(cast(cutoff - a as bigint), top)), "
        f"{ok} as (select * from {ip} where fit_at >= {smoothing.MIN_DAYS} and now_at >= {smoothing.MIN_DAYS} and seen >= {smoothing.MIN_FIT_DAYS}), "
        f"{bp} as (select f.grp, f.t, arg_min(gi, {{'s': sse, 'g': gi}}) as gi from {fo} f join (select distinct grp, fit_at from {ok}) k on k.grp = f.grp and k.fit_at = f.t group by 1, 2), "
        f"{ets} as (select i.grp, i.issue_date, i.cutoff, {path} as y_pred from {ok} i join {bp} p on p.grp = i.grp and p.t = i.fit_at join {fo} o on o.grp = i.grp and o.gi = p.gi and o.t = i.now_at)"
    )


def _smoothing_ctes(panel: str, s, start=SPAN[0], end=SPAN[1]) -> str:
    return f"{results_ctes(panel, s, start, end, (13,))}, " + _state_ctes("panel", "select * from results where model = 'plain_28d'", s)


def _member_ctes(panel: str, s, start=SPAN[0], end=SPAN[1]) -> str:
    """CTEs ending in ``td`` and ``members``: rows of both baselines, of smoothing, and of the smoothed total by recent shares."""
    keys = "spec, r.issue_date, r.cutoff, target_start, target_end, r.grp, y_true"
    return (
        f"{_smoothing_ctes(panel, s, start, end)}, ng as (select count(distinct grp) as g from panel), "
        "tot as (select date, cast(0 as bigint) as grp, case when count(n) = (select g from ng) then cast(sum(n) as bigint) end as n from panel group by date), "
        + _state_ctes("tot", "select distinct issue_date, cutoff, cast(0 as bigint) as grp from results", s, "_t")
        + ", sm as (select date, grp, sum(n) over w as s, count(n) over w as k from (select p.date, p.grp, case when tot.n is not null then p.n end as n from panel p join tot on tot.date = p.date) "
        f"window w as (partition by grp order by date rows between {SHARE_DAYS - 1} preceding and current row)), "
        f"sh as (select date as cutoff, grp, case when k >= {min_samples(SHARE_DAYS)} then cast(s as double) / nullif(sum(s) over (partition by date), 0) end as share from sm), "
        f"td as (select {keys}, share * t.y_pred as y_pred from results r join sh on sh.cutoff = r.cutoff and sh.grp = r.grp left join ets_t t on t.cutoff = r.cutoff where model = 'plain_28d'), "
        f"members as (select * from results union all select spec, 'ets_weekly', r.issue_date, r.cutoff, target_start, target_end, r.grp, y_true, e.y_pred from results r left join ets e on e.grp = r.grp and e.issue_date = r.issue_date where model = 'plain_28d' "
        "union all select spec, 'topdown_ets', issue_date, cutoff, target_start, target_end, grp, y_true, y_pred from td)"
    )


@query("j06_smoothing", f"with recursive {_smoothing_ctes(LINE_PANEL, DAILY)} select r.spec, 'ets_weekly' as model, r.issue_date, r.cutoff, r.target_start, r.target_end, r.grp, r.y_true, ets.y_pred "
       "from results r left join ets on ets.grp = r.grp and ets.issue_date = r.issue_date where r.model = 'plain_28d'")
def j06(spark, sf):
    p = line_panel(spark, sf)
    return smoothing.with_truth(smoothing.smoothing_forecasts(p, DAILY, *SPAN), p, DAILY, "ets_weekly")


@query("j06_smoothing_weekly_many_series", f"with recursive {_smoothing_ctes(SUPP_PANEL, WEEKLY)} select i.issue_date, i.cutoff, i.grp, ets.y_pred from iw i left join ets on ets.grp = i.grp and ets.issue_date = i.issue_date")
def j06m(spark, sf):
    return smoothing.smoothing_forecasts(supplier_panel(spark, sf), WEEKLY, *SPAN)


@query("j07_calendar_autoregression", f"with {results_ctes(LINE_PANEL, DAILY, *SPAN, (13,))} select 'ar_calendar' as model, issue_date, cutoff, target_start, target_end, grp, y_true, "
       "(select count(n) from panel p where p.grp = r.grp and p.date <= cast(date_trunc('month', issue_date) as date) - 2) >= 91 as predicted, true as no_worse from results r where model = 'plain_28d'")
def j07(spark, sf):
    p = staged(line_panel(spark, sf))
    return checked(smoothing.with_truth(smoothing.ar_forecasts(p, DAILY, *SPAN), p, DAILY, "ar_calendar"), X.feature_table(p, DAILY))


@query("j08_top_down_smoothing", f"with recursive {_member_ctes(LINE_PANEL, DAILY)} select * from members where model = 'topdown_ets'")
def j08(spark, sf):
    return H.topdown_smoothing(staged(line_panel(spark, sf)), DAILY, *SPAN)


_LIVE = (f"{ORDER_PANEL}, x as (select date, grp, n, {roll('avg', 'n', 28, 20)} as plain_28d, {same_weekday_sql(DAILY, 13)} as same_wd_13w from panel window w as (partition by grp order by date)), "
         "tot as (select date, cast(0 as bigint) as grp, case when count(n) = (select count(distinct grp) from panel) then cast(sum(n) as bigint) end as n from panel group by date), "
         f"base as (select date, {roll('avg', 'n', 28, 20)} as total from tot), ok as (select date, count(n) = (select count(distinct grp) from panel) as ok from panel group by date), "
         "m as (select panel.date, grp, case when ok then n end as n from panel join ok on ok.date = panel.date), s as (select date, grp, sum(n) over w as s, count(n) over w as k from m window w as (partition by grp order by date rows between 27 preceding and current row)), t as (select date, sum(s) as t from s group by date), "
         "e as (select x.date + 2 as issue_date, x.date + 3 as target_start, cast(x.grp as varchar) as grp, same_wd_13w, plain_28d, case when k >= 20 then cast(s.s as double) / nullif(t, 0) end * total as topdown_plain from x join s on s.date = x.date and s.grp = x.grp join t on t.date = x.date join base on base.date = x.date where x.date = (select max(date) from panel)), "
         "f as (select *, cast(round((same_wd_13w + plain_28d + topdown_plain) / 3.0) as bigint) as forecast from e)")


_SERIES_MODELS = ("linear", "ets_weekly", "ar_calendar", "topdown_ets")


@query("j09_registry_run", f"with {LINE_PANEL} select model, cast(date_trunc('month', date - 1) as date) as month, count(*) as n from panel cross join (values "
       + ", ".join(f"('{m}')" for m in _SERIES_MODELS) + f") v(model) where n is not null and date between date '{VALIDATION[0]}' and date '{VALIDATION[1]}' group by 1, 2")
def j09(spark, sf):
    """Scored rows of each registered model and issue month of one run."""
    rows = registry_run(staged(line_panel(spark, sf)), _SERIES_MODELS, DAILY, *VALIDATION, LINE_KEEP)
    done = rows.where("y_true is not null and y_pred is not null")
    return done.groupBy("model", F.trunc("issue_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("j10_live_forecast", f"with {_LIVE} select * from f union all select issue_date, target_start, 'All', sum(same_wd_13w), sum(plain_28d), sum(topdown_plain), cast(sum(forecast) as bigint) from f group by 1, 2")
def j10(spark, sf):
    return H.live_forecast(staged(order_panel(spark, sf)), DAILY)


@query("j10_ensemble_forecaster", f"with recursive {_member_ctes(LINE_PANEL, DAILY)} select issue_date, grp, case when count(y_pred) = 3 then avg(y_pred) end as y_pred from members where model in ('ets_weekly', 'topdown_ets', 'plain_28d') group by 1, 2")
def j10e(spark, sf):
    return H.ensemble_forecaster(H.member_rows(staged(line_panel(spark, sf)), DAILY, *SPAN), ["ets_weekly", "topdown_ets", "plain_28d"])


_HOLDOUT = (f"{_member_ctes(LINE_PANEL, DAILY, TEST_START, TEST_END)}, mean2 as (select target_start, any_value(y_true) as y_true, case when count(y_pred) = 2 then avg(y_pred) end as y_pred from members where model in ('ets_weekly', 'topdown_ets') group by issue_date, target_start, grp), "
            "every as (select model, target_start, y_true, y_pred from members union all select 'ens_mean', target_start, y_true, y_pred from mean2), "
            f"sc as (select *, y_pred - y_true as error, case when target_start < date '{BREAK_DATE}' then '{BEFORE}' else '{AFTER}' end as period from every where y_true is not null)")


@query("k08_holdout_scores", f"with recursive {_HOLDOUT} select model, period, count(*) as n, avg(abs(error)) as mae, avg(error) as bias, median(error) as median_error, avg(cast(error < 0 as double)) as under_share from sc group by 1, 2")
def k08(spark, sf):
    panel = staged(line_panel(spark, sf))
    rows = stage(H.holdout_results(panel, DAILY, TEST_START, TEST_END, BREAK_DATE), "holdout")
    return H.holdout_scores(H.require_both_periods(rows))


# The trial grid; trial 0 holds the defaults.
GRID = ({"regParam": 1e-4, "variancePower": 1.5}, {"regParam": 1e-2, "variancePower": 1.5}, {"regParam": 0.1, "variancePower": 1.5},
        {"regParam": 1e-4, "variancePower": 1.2}, {"regParam": 1e-2, "variancePower": 1.2}, {"regParam": 1.0, "variancePower": 1.8})
TUNE_MONTHS = months_between("1998-01-01", "1998-12-31")


@query("k10_tuning_trials")
def k10(spark, sf):
    feats = line_features(spark, sf)
    config = L.select_configs(["glm_tweedie"])[0]
    running = stage(T.run_trials(L.monthly_backtests(feats, config, DAILY, TUNE_MONTHS, GRID)).select("trial", "step", "running", "best_so_far"), "trials")
    return T.trial_log("glm_tweedie", GRID, T.apply_pruning(running))
