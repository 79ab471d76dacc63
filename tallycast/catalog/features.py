"""Feature, window and baseline queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.operators.profile import append_all
from tallycast.catalog.inputs import (
    HOLIDAY_SQL, LINE_PANEL, ORDER_PANEL, SERIES_SQL, SUPP_PANEL, SCORED_SQL, TEST_START, VALIDATION,
    days_sql, feature_ctes, forward_sql, line_panel, order_panel, results_ctes, roll, same_weekday_sql,
    schedule_sql, staged, supplier_panel, table, timing_sql, window_holiday_sql,
)
from tallycast.functions import calendar as cal
from tallycast.functions.stats import known_mean, log_ratio, one_hot, rolling, safe_ratio, strict_mean
from tallycast.operators import baselines as B
from tallycast.operators import features as X
from tallycast.operators.metrics import score
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import DAILY, WEEKLY, Setting, min_samples

START, END = VALIDATION

_FEAT = ", ".join((*X.KEY_COLUMNS, *X.LEVEL_COLUMNS, *X.CALENDAR_COLUMNS, "y"))


def _feature_query(name: str, setting: Setting, panel_sql: str, make):
    query(name, f"with {feature_ctes(panel_sql, setting)} select {_FEAT} from feat")(
        lambda spark, sf: X.feature_table(make(spark, sf), setting))


_feature_query("h01_feature_table", DAILY, ORDER_PANEL, order_panel)
_feature_query("h01_feature_table_weekly", WEEKLY, ORDER_PANEL, order_panel)
_feature_query("h01_feature_table_lead14", Setting(lead_days=14), LINE_PANEL, line_panel)


@query("h01_feature_table_many_series", f"with {feature_ctes(SUPP_PANEL, DAILY)} select grp, count(*) as n_rows, count(y) as known, sum(mean_28d) as s28, "
       "sum(sd_28d) as ssd, sum(same_wd_13w) as s13, sum(sub_share_28d) as share, sum(ratio_28_91) as ratio, cast(sum(holidays) as bigint) as hol from feat group by grp")
def h01m(spark, sf):
    return X.feature_table(supplier_panel(spark, sf), DAILY).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("known"), F.sum("mean_28d").alias("s28"), F.sum("sd_28d").alias("ssd"),
        F.sum("same_wd_13w").alias("s13"), F.sum("sub_share_28d").alias("share"), F.sum("ratio_28_91").alias("ratio"), F.sum("holidays").alias("hol"))


_ISSUE = "1999-11-15"


@query("h02_issue_rows", f"with {feature_ctes(ORDER_PANEL, DAILY)} select {_FEAT.replace(', y', '')} from feat where issue_date = date '{_ISSUE}'")
def h02(spark, sf):
    return X.issue_rows(order_panel(spark, sf), _ISSUE, DAILY).drop("y")


@query("h03_training_rows", f"with {feature_ctes(ORDER_PANEL, DAILY)} select grp, count(*) as n_rows, min(cutoff) as first_cutoff, max(cutoff) as last_cutoff, sum(y) as total "
       "from feat where y is not null and mean_28d > 0 group by grp")
def h03(spark, sf):
    return X.training_rows(X.feature_table(order_panel(spark, sf), DAILY)).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("cutoff").alias("first_cutoff"), F.max("cutoff").alias("last_cutoff"), F.sum("y").alias("total"))


@query("h14_level_offset", f"with {feature_ctes(ORDER_PANEL, WEEKLY)} select issue_date, grp, mean_28d * 7 as level, case when mean_28d * 7 > 0 then ln(mean_28d * 7) end as log_level from feat")
def h14(spark, sf):
    o = X.level_offset(WEEKLY)
    return X.feature_table(order_panel(spark, sf), WEEKLY).select("issue_date", "grp", *(c.alias(k) for k, c in o.items()))


# --- single window operators ----------------------------------------------------------

def _win(name, exprs_sql: dict, exprs, panel_sql=ORDER_PANEL, make=order_panel):
    body = ", ".join(f"{e} as {k}" for k, e in exprs_sql.items())

    def run(spark, sf):
        return make(spark, sf).select("date", "grp", *(c.alias(k) for k, c in exprs().items()))

    query(name, f"with {panel_sql} select date, grp, {body} from panel {SERIES_SQL}")(run)


def n():
    return F.col("n")


def sub():
    return F.col("n_sub")


_win("e01_cutoff_lags", {f"lag_{k}": f"lag(n, {k}) over w" for k in range(7)},
     lambda: {f"lag_{k}": F.lag(n(), k).over(X.series()) for k in range(7)})
_win("e02_target_lags", {f"lag_{k}": f"lag(n, {k}) over w" for k in X.STRICT_LAGS},
     lambda: {f"lag_{k}": F.lag(n(), k).over(X.series()) for k in X.STRICT_LAGS})
_win("e03_rolling_means", {f"mean_{d}d": roll("avg", "n", d, min_samples(d)) for d in X.MEAN_DAYS},
     lambda: {f"mean_{d}d": rolling(F.avg, n(), X.series(), d, min_samples(d)) for d in X.MEAN_DAYS})
_win("e04_rolling_sd", {"sd_28d": roll("stddev_samp", "n", 28, 20)}, lambda: {"sd_28d": rolling(F.stddev_samp, n(), X.series(), 28, 20)})
_win("e05_subset_share", {f"share_{d}d": f"cast(({roll('sum', 'n_sub', d, min_samples(d))}) as double) / nullif(cast(({roll('sum', 'n', d, min_samples(d))}) as double), 0)" for d in (7, 28)},
     lambda: {f"share_{d}d": safe_ratio(rolling(F.sum, sub(), X.series(), d, min_samples(d)), rolling(F.sum, n(), X.series(), d, min_samples(d))) for d in (7, 28)})
_win("e06_level_ratios", {"ratio_7_28": f"({roll('avg', 'n', 7, 5)}) / nullif(({roll('avg', 'n', 28, 20)}), 0)", "ratio_28_91": f"({roll('avg', 'n', 28, 20)}) / nullif(({roll('avg', 'n', 91, 64)}), 0)"},
     lambda: {"ratio_7_28": safe_ratio(rolling(F.avg, n(), X.series(), 7, 5), rolling(F.avg, n(), X.series(), 28, 20)),
              "ratio_28_91": safe_ratio(rolling(F.avg, n(), X.series(), 28, 20), rolling(F.avg, n(), X.series(), 91, 64))})
@query("e07_same_weekday_bulk", f"with {ORDER_PANEL} select date, grp, {same_weekday_sql(WEEKLY, 4)} as same_wd_4w, {same_weekday_sql(WEEKLY, 13)} as same_wd_13w from panel {SERIES_SQL}")
def e07(spark, sf):
    longer = X.extend(order_panel(spark, sf), X.horizon_days(WEEKLY))
    per_day = X.with_same_weekday(longer, WEEKLY, (4, 13)).where("__real")
    return per_day.select("date", "grp", *((F.col(c) / 7).alias(c) for c in ("same_wd_4w", "same_wd_13w")))


_win("e08_forward_total", {"y_daily": forward_sql(DAILY), "y_weekly": forward_sql(WEEKLY)},
     lambda: {"y_daily": X.forward_total(n(), DAILY), "y_weekly": X.forward_total(n(), WEEKLY)})
_win("e09_strict_rolling_mean", {f"rolling_mean_{k}": roll("avg", "n", k, k, -3) for k in (7, 14)},
     lambda: {f"rolling_mean_{k}": rolling(F.avg, n(), X.series(), k, k, end=-3) for k in (7, 14)})


_STRICT_SQL = (f"{ORDER_PANEL}, strict as (select date, grp, n, cast(isodow(date) - 1 as bigint) as day_of_week, cast(month(date) as bigint) as month, "
               "cast(day(date) as bigint) as day_of_month, cast(isodow(date) >= 6 as bigint) as is_weekend, cast(dayofyear(date) as bigint) as day_of_year, "
               + ", ".join(f"cast(lag(n, {k}) over w as double) as lag_{k}" for k in X.STRICT_LAGS) + ", "
               + ", ".join(f"{roll('avg', 'n', k, k, -3)} as rolling_mean_{k}" for k in (7, 14)) + f" from panel {SERIES_SQL})")


@query("h04_strict_features", f"with {_STRICT_SQL} select * from strict where n is not null")
def h04(spark, sf):
    return X.strict_features(order_panel(spark, sf)).where("n is not null")


@query("b06_strict_calendar", f"with {_STRICT_SQL} select distinct date, day_of_week, month, day_of_month, is_weekend, day_of_year from strict")
def b06(spark, sf):
    return table(spark, sf, "orders").agg(F.sequence(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).alias("d")).select(
        F.explode("d").alias("date")).select("date", *(c.alias(k) for k, c in X.strict_calendar(F.col("date")).items()))


_MISS = " or ".join(f"{c} is null" for c in X.STRICT_NUMERIC)


@query("e19_feature_completeness", f"with {_STRICT_SQL}, f as (select *, min(date) over (partition by grp) as first_day from strict) "
       f"select grp, count(*) as rows, count(*) filter (where {_MISS}) as rows_missing_feature, "
       f"count(*) filter (where ({_MISS}) and date - first_day < 28) as missing_at_start, count(*) filter (where ({_MISS}) and date - first_day >= 28) as missing_from_gap, "
       "count(*) filter (where n is null) as unknown_target from f group by grp")
def e19(spark, sf):
    return X.feature_completeness(X.strict_features(order_panel(spark, sf)))


@query("e13_day_steps", f"with {ORDER_PANEL}, s as (select grp, date - lag(date) over w as step from panel {SERIES_SQL}) "
       "select grp, count(step) as steps, count(*) filter (where step <> 1) as broken_steps from s group by grp")
def e13(spark, sf):
    return X.day_steps(order_panel(spark, sf))


def _roll_ref(k: int) -> str:
    return (f"(select grp, date + cast(s as integer) as date, case when count(n) = {k} then avg(n) end as m "
            f"from (select * from panel cross join (select unnest(generate_series(3, {k + 2})) as s)) q group by grp, date + cast(s as integer))")


_align = " union all ".join(
    [f"select 'lag_{k}' as feature, count(*) as compared, count(*) filter (where a.lag_{k} is distinct from b.n) as mismatches from strict a left join panel b on b.grp = a.grp and b.date = a.date - {k}" for k in X.STRICT_LAGS]
    + [f"select 'rolling_mean_{k}', count(*), count(*) filter (where not (a.rolling_mean_{k} is not distinct from b.m or coalesce(abs(a.rolling_mean_{k} - b.m) <= 1e-9 * greatest(abs(b.m), 1.0), false))) from strict a left join {_roll_ref(k)} b on b.grp = a.grp and b.date = a.date" for k in X.STRICT_MEANS])


@query("c10_shifted_self_join", f"with {_STRICT_SQL} {_align}")
def c10(spark, sf):
    p = staged(order_panel(spark, sf))
    return X.lag_alignment(X.strict_features(p), p)


_SHIFTED = (f"{_STRICT_SQL}, bad as (select date, grp, case when n = 0 then 1.0 else rolling_mean_7 end as rolling_mean_7 from strict), "
            "ex as (select grp, date + cast(s as integer) as date, n from panel cross join (select unnest(generate_series(3, 9)) as s)), "
            "ref as (select grp, date, case when count(n) = 7 then avg(n) end as expected from ex group by grp, date)")


@query("e20_alignment_audit", f"with {_SHIFTED} select 'rolling_mean_7' as feature, count(*) as compared, count(*) filter (where not (bad.rolling_mean_7 is not distinct from expected "
       "or coalesce(abs(bad.rolling_mean_7 - expected) <= 1e-9 * greatest(abs(expected), 1.0), false))) as mismatches from bad left join ref on ref.grp = bad.grp and ref.date = bad.date")
def e20(spark, sf):
    """The audit on a table with deliberately misaligned values: it must count them."""
    p = staged(order_panel(spark, sf))
    bad = X.strict_features(p).withColumn("rolling_mean_7", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("rolling_mean_7")))
    return X.lag_alignment(bad, p, lags=(), means=(7,))


@query("e10_valid_row_average", f"with {ORDER_PANEL}, v as (select date, grp, cast(isodow(date) - 1 as bigint) as wd, n from panel where n is not null) "
       "select date, grp, wd, " + ", ".join(f"case when count(n) over (partition by grp, wd order by date rows between {k - 1} preceding and current row) >= {k} then avg(n) over (partition by grp, wd order by date rows between {k - 1} preceding and current row) end as avg_{k}" for k in (4, 13)) + " from v")
def e10(spark, sf):
    return B.valid_row_means(order_panel(spark, sf), (4, 13))


_VALID = (f"{ORDER_PANEL}, v as (select date, grp, isodow(date) as wd, n from panel where n is not null), "
          "f as (select date, grp, wd, " + ", ".join(f"case when count(n) over (partition by grp, wd order by date rows between {k - 1} preceding and current row) >= {k} then avg(n) over (partition by grp, wd order by date rows between {k - 1} preceding and current row) end as avg_{k}" for k in B.VALID_ROW_CANDIDATES) + " from v), "
          f"pr as (select date as target, grp, isodow(date) as wd, date - 3 as cutoff, n as actual from panel where date between date '{START}' and date '{END}'), "
          "vb as (select pr.grp, cast(pr.wd - 1 as bigint) as wd, target, cutoff, actual, f.date as matched_date, " + ", ".join(f"f.avg_{k}" for k in B.VALID_ROW_CANDIDATES)
          + " from pr asof left join f on f.grp = pr.grp and f.wd = pr.wd and f.date <= pr.cutoff)")


@query("h07_valid_row_baseline", f"with {_VALID} select * from vb")
def h07(spark, sf):
    return B.valid_row_baseline(order_panel(spark, sf), START, END, B.VALID_ROW_CANDIDATES)


def _sweep(spark, sf):
    vb = h07(spark, sf).where("actual is not null")
    keys = ["grp", "target", "actual"]
    long = vb.select(*keys, *(F.col(f"avg_{k}").alias(str(k)) for k in B.VALID_ROW_CANDIDATES)).unpivot(
        keys, [str(k) for k in B.VALID_ROW_CANDIDATES], "window", "pred")
    return long.select("grp", F.year("target").cast("bigint").alias("year"), F.col("window").cast("bigint").alias("window"),
                       (F.col("pred") - F.col("actual")).alias("error"))


_SWEEP = f"{_VALID}, sw as (" + " union all ".join(
    f"select grp, cast(year(target) as bigint) as year, cast({k} as bigint) as win, avg_{k} - actual as error from vb where actual is not null" for k in B.VALID_ROW_CANDIDATES) + ")"


@query("h08_window_sweep", f"with {_SWEEP} select win as \"window\", count(error) as n, avg(abs(error)) as mae, avg(error) as bias from sw group by win")
def h08(spark, sf):
    return _sweep(spark, sf).groupBy("window").agg(F.count("error").alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"))


def _best_window(spark, sf, by):
    t = _sweep(spark, sf).groupBy(by, "window").agg(F.avg(F.abs("error")).alias("mae"))
    return t.groupBy(by).agg(F.min_by("window", F.struct("mae", "window")).alias("best_window"), F.min("mae").alias("mae"))


for _by in ("grp", "year"):
    query(f"g02_best_window_by_{_by}", f"with {_SWEEP}, t as (select {_by}, win, avg(abs(error)) as mae from sw group by {_by}, win) "
          f"select {_by}, arg_min(win, {{'m': mae, 'w': win}}) as best_window, min(mae) as mae from t group by {_by}")(
        lambda spark, sf, by=_by: _best_window(spark, sf, by))


_PREV = ", ".join(
    f"list_avg(list_value({', '.join(f'lag(n, {7 * i}) over w' for i in range(1, k + 1))})) as same_wd_{k}w" for k in (4, 8, 13))
_PREV_MODELS = ("same_wd_4w", "same_wd_8w", "same_wd_13w", "plain_28d")


@query("h09_preview_baselines", f"with {LINE_PANEL}, p as (select date, grp, n, {_PREV}, {roll('avg', 'n', 28, 20, -3)} as plain_28d from panel {SERIES_SQL}) "
       "select coalesce(cast(grp as varchar), 'all') as grp, count(*) as days, " + ", ".join(f"avg(abs({m} - n)) as mae_{m}, avg({m} - n) as bias_{m}" for m in _PREV_MODELS)
       + " from p where year(date) = 1999 and n is not null group by grouping sets ((grp), ())")
def h09(spark, sf):
    p = B.preview_baselines(line_panel(spark, sf), (4, 8, 13)).where((F.year("date") == 1999) & F.col("n").isNotNull())
    aggs = [F.count(F.lit(1)).alias("days")]
    for m in _PREV_MODELS:
        aggs += [F.avg(F.abs(F.col(m) - F.col("n"))).alias(f"mae_{m}"), F.avg(F.col(m) - F.col("n")).alias(f"bias_{m}")]
    return p.rollup("grp").agg(*aggs).withColumn("grp", F.coalesce(F.col("grp").cast("string"), F.lit("all")))


def _span_issues(spark, sf, setting):
    """Issue dates over the whole span of the orders table."""
    p = order_panel(spark, sf)
    days = p.select("date").distinct().withColumn("target_start", F.col("date")).withColumn("target_end", F.date_add("date", setting.window_days - 1))
    issue = setting.issue_of_start(F.col("target_start"))
    return p, days.where(B.in_schedule(setting, START, END)).select(
        issue.alias("issue_date"), setting.cutoff_of_issue(issue).alias("cutoff"), "target_start", "target_end")


_ISS = "iss as (select target_start - {lead} as issue_date, target_start - {gap} as cutoff, target_start, target_end from (select distinct date as target_start, date + {w1} as target_end from panel) t where {sched})"


def _iss(s):
    return _ISS.format(lead=s.lead_days, gap=s.gap_days, w1=s.window_days - 1, sched=schedule_sql(s, START, END))


_THREE = (DAILY, WEEKLY, Setting(lead_days=3, window_days=5))


@query("h10_issue_dates", " union all ".join(f"select * from (with {ORDER_PANEL}, {_iss(s)} select '{s.key}' as spec, * from iss) q{i}" for i, s in enumerate(_THREE)))
def h10(spark, sf):
    """Schedules of three settings over the days of the orders."""
    return append_all([_span_issues(spark, sf, s)[1].select(F.lit(s.key).alias("spec"), "*") for s in _THREE])


@query("h11_actual_totals", f"with {ORDER_PANEL}, {_iss(WEEKLY)}, w as (select issue_date, target_start + cast(j as integer) as date from iss cross join (select unnest(generate_series(0, 6)) as j) r) "
       "select w.issue_date, panel.grp, case when count(n) = 7 then cast(sum(n) as double) end as y_true from w join panel on panel.date = w.date group by 1, 2")
def h11(spark, sf):
    p, iss = _span_issues(spark, sf, WEEKLY)
    return B.actual_totals(p, iss, WEEKLY)


@query("h12_month_folds", f"with {ORDER_PANEL}, {_iss(WEEKLY)} select strftime(issue_date, '%Y-%m') as month, min(target_start) as first_target, max(target_end) as last_target, count(*) as issues from iss group by 1")
def h12(spark, sf):
    _, iss = _span_issues(spark, sf, WEEKLY)
    return iss.groupBy(cal.year_month(F.col("issue_date")).alias("month")).agg(
        F.min("target_start").alias("first_target"), F.max("target_end").alias("last_target"), F.count(F.lit(1)).alias("issues"))


def _lookup_sql(s, weeks):
    return (f"{_iss(s)}, td as (select issue_date, cutoff, target_start + cast(j as integer) as target_day from iss cross join (select unnest(generate_series(0, {s.window_days - 1})) as j) r), "
            f"src as (select issue_date, target_day, target_day - 7 * cast(k + ceil((target_day - cutoff) / 7.0) as integer) as date from td cross join (select unnest(generate_series(0, {weeks - 1})) as k) r2), "
            f"dp as (select src.issue_date, grp, target_day, case when count(n) >= {min_samples(weeks)} then avg(n) end as day_pred from src join panel on panel.date = src.date group by 1, 2, 3)")


@query("c12_source_days", f"with {ORDER_PANEL}, {_lookup_sql(WEEKLY, 4)} select * from src")
def c12(spark, sf):
    _, iss = _span_issues(spark, sf, WEEKLY)
    return B.source_days(iss, WEEKLY, 4)


@query("h06_same_weekday_lookup", f"with {ORDER_PANEL}, {_lookup_sql(WEEKLY, 13)} select issue_date, grp, case when count(day_pred) = 7 then sum(day_pred) end as y_pred from dp group by 1, 2")
def h06(spark, sf):
    p, iss = _span_issues(spark, sf, WEEKLY)
    return B.same_weekday_lookup(p, iss, WEEKLY, 13)


@query("h06_same_weekday_bulk", f"with {ORDER_PANEL}, wide as (select grp, {timing_sql(WEEKLY)}, {same_weekday_sql(WEEKLY, 13)} * 7 as y_pred from panel {SERIES_SQL}) select issue_date, grp, y_pred from wide where {schedule_sql(WEEKLY, START, END)}")
def h06b(spark, sf):
    longer = X.with_same_weekday(X.extend(order_panel(spark, sf), X.horizon_days(WEEKLY)), WEEKLY, (13,))
    wide = X.with_timing(longer.where("__real").withColumnRenamed("same_wd_13w", "y_pred"), WEEKLY)
    return wide.where(B.in_schedule(WEEKLY, START, END)).select("issue_date", "grp", "y_pred")


@query("h05_plain_mean", f"with {ORDER_PANEL}, wide as (select grp, {timing_sql(WEEKLY)}, ({roll('avg', 'n', 28, 20)}) * 7 as plain_28d, ({roll('avg', 'n', 7, 7)}) * 7 as plain_7d from panel) select issue_date, grp, plain_28d, plain_7d from wide")
def h05(spark, sf):
    p = order_panel(spark, sf).select("date", "grp", B.plain_mean(WEEKLY).alias("plain_28d"), B.plain_mean(WEEKLY, 7, 7).alias("plain_7d"))
    return X.with_timing(p, WEEKLY).select("issue_date", "grp", "plain_28d", "plain_7d")


# --- timing, calendar and scalar helpers ----------------------------------------------

@query("b15_timing_columns", "with d as (select distinct cast(o_orderdate as date) as date from orders) " + " union all ".join(
    f"select '{s.key}' as spec, {timing_sql(s)} from d" for s in (DAILY, WEEKLY)))
def b15(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    cols = ["spec", "issue_date", "cutoff", "target_start", "target_end"]
    a, b = (X.with_timing(d, s).withColumn("spec", F.lit(s.key)).select(*cols) for s in (DAILY, WEEKLY))
    return a.unionByName(b)


@query("b07_yearly_cycle", "select distinct cast(l_shipdate as date) as date, " + ", ".join(
    f"sin(2*pi()*{k}*dayofyear(l_shipdate)/365.25) as doy_sin_{k}, cos(2*pi()*{k}*dayofyear(l_shipdate)/365.25) as doy_cos_{k}" for k in (1, 2, 3)) + " from lineitem")
def b07(spark, sf):
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return d.select("date", *(c.alias(k) for k, c in cal.fourier(F.col("date"), 3).items()))


@query("b08_holidays", f"with {HOLIDAY_SQL}, y as (select distinct cast(year(o_orderdate) as bigint) as yr from orders) select holiday, count(*) over (partition by year(holiday)) as in_year from hol where year(holiday) in (select yr from y)")
def b08(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr")).distinct()
    span = years.agg(F.min("yr").alias("lo"), F.max("yr").alias("hi")).first()
    hol = cal.holiday_table(spark, span.lo, span.hi).select("holiday", F.count(F.lit(1)).over(Window.partitionBy(F.year("holiday"))).alias("in_year"))
    return hol.join(years, F.year("holiday") == F.col("yr"), "left_semi")


@query("b09_window_holidays", f"with {HOLIDAY_SQL}, {window_holiday_sql('select distinct cast(o_orderdate as date) as s from orders', 7)} select s as target_start, holidays, holiday_adjacent from wh")
def b09(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("target_start")).distinct()
    return cal.window_calendar(d, "target_start", 7).select("target_start", "holidays", "holiday_adjacent")


@query("b12_log_ratio", f"with {feature_ctes(ORDER_PANEL, DAILY)} select issue_date, grp, case when ratio_7_28 is null then 0.0 else ln(greatest(ratio_7_28, 0.05)) end as log_ratio_7_28, "
       "case when lag_0 / nullif(mean_28d, 0) is null then 0.0 else ln(greatest(lag_0 / nullif(mean_28d, 0), 0.05)) end as log_lag_0_rel from feat")
def b12(spark, sf):
    f = X.feature_table(order_panel(spark, sf), DAILY)
    return f.select("issue_date", "grp", log_ratio(F.col("ratio_7_28"), 0.05).alias("log_ratio_7_28"),
                    log_ratio(safe_ratio(F.col("lag_0"), F.col("mean_28d")), 0.05).alias("log_lag_0_rel"))


@query("b13_one_hot", "select l_linenumber as line, " + ", ".join(f"cast(l_linenumber = {k} as double) as line_{k}" for k in range(2, 8)) + ", count(*) as n from lineitem group by all")
def b13(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return li.select("line", "n", *(c.alias(k) for k, c in one_hot(F.col("line"), list(range(2, 8)), "line").items()))


@query("b14_columnwise_stats", f"with {ORDER_PANEL}, l as (select date, grp, lag(n, 1) over w as a, lag(n, 7) over w as b, lag(n, 14) over w as c from panel {SERIES_SQL}) "
       "select date, grp, (a + b + c) / 3.0 as strict_mean, least(a, b, c) as lowest, list_avg(list_value(a, b, c)) as known_mean from l")
def b14(spark, sf):
    l = order_panel(spark, sf).select("date", "grp", *(F.lag(n(), k).over(X.series()).alias(c) for c, k in (("a", 1), ("b", 7), ("c", 14))))
    abc = [F.col(c) for c in "abc"]
    return l.select("date", "grp", strict_mean(abc).alias("strict_mean"), F.least(*abc).alias("lowest"), known_mean(abc, 1).alias("known_mean"))


@query("e16_total_smoothing", f"with {ORDER_PANEL}, tot as (select date, cast(0 as bigint) as grp, case when count(n) = (select count(distinct grp) from panel) then cast(sum(n) as bigint) end as n from panel group by date) select date, n, {roll('avg', 'n', 28, 20)} as roll28 from tot")
def e16(spark, sf):
    from tallycast.operators.panel import total_series

    t = total_series(order_panel(spark, sf), n_groups=5)
    return t.select("date", "n", rolling(F.avg, n(), X.series(), 28, 20).alias("roll28"))


@query("e21_latest_rows", f"with {ORDER_PANEL}, r as (select *, row_number() over (partition by grp, isodow(date) order by date desc) as rk from panel where n is not null) "
       "select grp, cast(isodow(date) as bigint) as weekday, avg(n) as recent_mean, min(date) as oldest from r where rk <= 13 group by 1, 2")
def e21(spark, sf):
    p = order_panel(spark, sf).where("n is not null").withColumn("weekday", cal.iso_weekday(F.col("date")))
    w = Window.partitionBy("grp", "weekday").orderBy(F.desc("date"))
    return p.withColumn("rk", F.row_number().over(w)).where("rk <= 13").groupBy("grp", "weekday").agg(
        F.avg("n").alias("recent_mean"), F.min("date").alias("oldest"))


# --- rolling origin -------------------------------------------------------------------

_SCORE = "select model, grp, count(*) as n, avg(abs(error)) as mae, avg(error) as bias, median(error) as median_error, avg(cast(error < 0 as double)) as under_share from sc group by model, grp"


@query("k00_backtest_scores", f"with {results_ctes(LINE_PANEL, DAILY, START, END)}, {SCORED_SQL} {_SCORE}")
def k00(spark, sf):
    return score(rolling_origin(line_panel(spark, sf), DAILY, START, END, test_start=TEST_START), ["grp"])


@query("k00_backtest_rows", f"with {results_ctes(ORDER_PANEL, DAILY, START, END)} select * from results")
def k00r(spark, sf):
    return rolling_origin(order_panel(spark, sf), DAILY, START, END)


@query("k00_backtest_weekly", f"with {results_ctes(LINE_PANEL, WEEKLY, START, END)} select * from results")
def k00w(spark, sf):
    return rolling_origin(line_panel(spark, sf), WEEKLY, START, END)


@query("k00_backtest_many_series", f"with {results_ctes(SUPP_PANEL, DAILY, START, END, (4, 13))}, {SCORED_SQL} "
       + _SCORE.replace("model, grp, count", "model, count").replace("group by model, grp", "group by model"))
def k00m(spark, sf):
    return score(rolling_origin(supplier_panel(spark, sf), DAILY, START, END, (4, 13)))


@query("k00_backtest_guards", f"with {results_ctes(ORDER_PANEL, DAILY, START, END)}, g as (select model, issue_date, grp, count(*) as c, count(*) filter (where y_true is not null and y_pred is null) as bad, count(*) filter (where y_true is null) as unk from results group by 1, 2, 3) "
       "select model, cast(sum(c) as bigint) as rows, cast(sum(bad) as bigint) as null_forecasts, cast(sum(unk) as bigint) as unknown_truth, count(*) filter (where c > 1) as repeated_keys from g group by model")
def k00g(spark, sf):
    from tallycast.operators.metrics import guard_counts

    return guard_counts(rolling_origin(order_panel(spark, sf), DAILY, START, END))
