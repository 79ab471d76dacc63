"""Threshold and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import LINE_PANEL, SCORED_SQL, VALIDATION, line_panel, results_ctes, staged
from tallycast.operators import alerts as A
from tallycast.operators import metrics as M
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import DAILY

START, END = VALIDATION
_FR = "over (partition by grp order by date rows between 93 preceding and 3 preceding)"
_THR = f"th as (select date, grp, n, quantile_cont(n, 0.10) {_FR} as low, quantile_cont(n, 0.90) {_FR} as high, count(n) {_FR} as valid_days from panel)"


@query("e11_rolling_thresholds", f"with {LINE_PANEL}, {_THR} select * from th")
def e11(spark, sf):
    return A.rolling_thresholds(line_panel(spark, sf))


_EXP = ("mo as (select cast(unnest(generate_series(timestamp '1996-01-01', timestamp '1999-12-01', interval 1 month)) as date) as month), "
        "ex as (select grp, month, quantile_cont(n, 0.90) as threshold, count(n) as known_days from mo join panel on panel.date <= month - 3 group by grp, month)")


@query("e12_expanding_thresholds", f"with {LINE_PANEL}, {_EXP} select * from ex")
def e12(spark, sf):
    return A.expanding_thresholds(line_panel(spark, sf), "1996-01-01", "1999-12-01")


_FLAG = f"{results_ctes(LINE_PANEL, DAILY, START, END, (4, 13))}, {SCORED_SQL}, {_EXP}, fl as (select sc.*, threshold from sc left join ex on ex.grp = sc.grp and ex.month = date_trunc('month', target_start))"


def flagged(spark, sf):
    p = staged(line_panel(spark, sf))
    r = rolling_origin(p, DAILY, START, END, (4, 13)).where("y_true is not null")
    return A.with_month_threshold(r, A.expanding_thresholds(p, "1996-01-01", "1999-12-01"))


@query("l09_high_demand_scores", f"with {_FLAG} select model, grp, count(*) as n, avg(abs(error)) as mae, avg(error) as bias from fl where y_true >= threshold group by model, grp")
def l09(spark, sf):
    return A.high_demand_scores(flagged(spark, sf), ["grp"])


@query("l10_warning_metrics", f"with {_FLAG}, w as (select model, count(*) filter (where y_true >= threshold) as high_days, count(*) filter (where y_pred >= threshold) as warnings, count(*) filter (where y_true >= threshold and y_pred >= threshold) as correct_warnings from fl group by model) "
       "select *, cast(correct_warnings as double) / nullif(high_days, 0) as recall, cast(correct_warnings as double) / nullif(warnings, 0) as precision from w")
def l10(spark, sf):
    return A.warning_metrics(flagged(spark, sf))


def _cls(v, strict):
    hi, lo = (">", "<") if strict else (">=", "<=")
    return f"case when {v} is not null and low is not null and high is not null then case when {v} {hi} high then 'High' when {v} {lo} low then 'Low' else 'Normal' end end"


def _alerts_sql(strict):
    return (f"with {results_ctes(LINE_PANEL, DAILY, START, END, (4, 13))}, {SCORED_SQL}, {_THR}, c as (select model, {_cls('y_true', strict)} as a, {_cls('y_pred', strict)} as p from sc join th on th.grp = sc.grp and th.date = sc.target_start), "
            "k as (select model, cat as category, count(*) filter (where a = cat) as actual_days, count(*) filter (where a is not null and p = cat) as alerts, count(*) filter (where a = cat and p = cat) as correct_alerts from c cross join (values ('High'), ('Low')) v(cat) group by model, cat) "
            "select *, cast(correct_alerts as double) / nullif(actual_days, 0) as recall, cast(correct_alerts as double) / nullif(alerts, 0) as precision from k")


def class_rows(spark, sf):
    p = staged(line_panel(spark, sf))
    r = rolling_origin(p, DAILY, START, END, (4, 13)).where("y_true is not null")
    th = A.rolling_thresholds(p).select("grp", F.col("date").alias("target_start"), "low", "high")
    return r.join(th, ["grp", "target_start"])


for _name, _strict in (("l11_class_alerts", False), ("l12_class_alerts_strict", True)):
    query(_name, _alerts_sql(_strict))(lambda spark, sf, s=_strict: A.class_alerts(class_rows(spark, sf), s))


@query("l12_class_comparison", f"with {LINE_PANEL}, {_THR}, i as (select {_cls('n', False)} as a, {_cls('n', True)} as b from th) select category, count(*) filter (where x = 1) as inclusive, count(*) filter (where x = 2) as strict from (select a as category, 1 as x from i union all select b, 2 from i) q where category is not null group by category")
def l12(spark, sf):
    return A.class_comparison(A.rolling_thresholds(line_panel(spark, sf)))
