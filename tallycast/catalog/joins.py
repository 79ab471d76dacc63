"""Join queries (C3, C4, C6-C9, C11, C13) and the lag audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import (
    ORDER_PANEL, ORDER_REC, LINE_PANEL, VALIDATION, line_panel, order_panel, order_records, results_ctes, roll, table,
)
from tallycast.functions.calendar import iso_weekday
from tallycast.operators import anomalies as A
from tallycast.operators import joins as J
from tallycast.operators import lag_audit as L
from tallycast.operators import metrics as M
from tallycast.plans.backtest import rolling_origin
from tallycast.spec import DAILY, WEEKLY

START, END = VALIDATION


@query("c03_validated_join", "select o_orderkey, o_custkey, c_mktsegment, c_nationkey from orders join customer on c_custkey = o_custkey")
def c03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return J.validated_join(o, c, ["o_custkey"], "many_to_one").select("o_orderkey", "o_custkey", "c_mktsegment", "c_nationkey")


@query("c03_join_audit", "with l as (select l_orderkey as k, count(*) as n, min(cast(l_shipdate as date)) as lo, max(cast(l_shipdate as date)) as hi from lineitem group by 1), o as (select o_orderkey as k, count(*) as n, min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi from orders group by 1) "
       "select count(*) filter (where l.n is not null and o.n is not null) as matched_keys, count(*) filter (where o.n is null) as left_only, count(*) filter (where l.n is null) as right_only, count(*) filter (where l.n > 1) as left_repeated, count(*) filter (where o.n > 1) as right_repeated, "
       "count(*) filter (where l.n is not null and o.n is not null and not (l.lo is not distinct from o.lo and l.hi is not distinct from o.hi)) as disagreeing from l full outer join o on o.k = l.k")
def c03a(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("a"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("b"))
    return J.join_audit(l, o, ["k"], "a", "b")


@query("c04_semi_join_coverage", f"with {results_ctes(ORDER_PANEL, DAILY, START, END, (4, 13))}, keys as (select distinct issue_date, grp from results where model = 'plain_28d' and y_pred is not null) "
       "select model, count(*) as rows, (select count(*) from keys) as wanted, count(*) = (select count(*) from keys) as covers from results r where exists (select 1 from keys k where k.issue_date = r.issue_date and k.grp = r.grp) group by model")
def c04(spark, sf):
    r = rolling_origin(order_panel(spark, sf), DAILY, START, END, (4, 13))
    keys = r.where("model = 'plain_28d' and y_pred is not null").select("issue_date", "grp").distinct()
    wanted = keys.select(F.count(F.lit(1))).scalar()
    return r.join(keys, ["issue_date", "grp"], "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("rows")).select(
        "model", "rows", wanted.alias("wanted"), (F.col("rows") == wanted).alias("covers"))


_Z = 2.5
_CAL = (f"rs as (select date, grp, n, n - ({roll('avg', 'n', 28, 20)}) as resid from panel), c1 as (select *, median(resid) over (partition by grp) as c from rs), "
        "c2 as (select *, 1.4826 * median(abs(resid - c)) over (partition by grp) as s from c1), "
        f"cal as (select date, grp, n, resid, case when n is not null then (resid - c) / nullif(s, 0) end as z, case when n is not null then (resid - c) / nullif(s, 0) end > {_Z} as anomaly from c2)").replace("cal as", "acal as")


def anomaly_calendar(spark, sf):
    return A.robust_z(A.mean_residuals(order_panel(spark, sf), 28, 20), _Z)


@query("q07_anomaly_days", f"with {ORDER_PANEL}, {_CAL} select date, grp, n, resid, z, anomaly from acal")
def q07(spark, sf):
    return anomaly_calendar(spark, sf)


@query("d28_anomaly_summary", f"with {ORDER_PANEL}, {_CAL} select grp, count(*) as days, count(*) filter (where anomaly) as anomalies, 100 * avg(cast(anomaly as double)) as pct, count(*) filter (where z < -{_Z}) as unusually_low, max(z) as max_z from acal where z is not null group by grp")
def d28(spark, sf):
    return A.anomaly_summary(anomaly_calendar(spark, sf), _Z)


_SHOCK = "sh as (select date, count(*) as groups from acal where anomaly group by date having count(*) >= 2)"


@query("d27_shared_shocks", f"with {ORDER_PANEL}, {_CAL}, {_SHOCK} select * from sh")
def d27(spark, sf):
    return A.shared_shocks(anomaly_calendar(spark, sf), 2)


@query("c13_shock_context", f"with {ORDER_PANEL}, {_CAL}, {_SHOCK}, cells as (select cast(o_orderdate as date) as date, o_orderpriority as l, count(*) as c, count(*) filter (where o_orderstatus = 'F') as f from orders where cast(o_orderdate as date) in (select date from sh) group by 1, 2) "
       "select sh.date, sh.groups, cast(sum(c) as bigint) as n, 100 * cast(sum(f) as double) / nullif(sum(c), 0) as pct_flag, arg_min(l, {'c': -c, 'l': l}) as top_label, strftime(sh.date, '%a') as weekday from sh join cells on cells.date = sh.date group by sh.date, sh.groups")
def c13(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", "o_orderstatus")
    return A.shock_context(d27(spark, sf), o, F.col("o_orderdate"), F.col("o_orderstatus") == "F", "o_orderpriority")


@query("c06_interval_join", f"with {results_ctes(ORDER_PANEL, WEEKLY, START, END, (4,))}, {_CAL} select model, issue_date, results.grp, y_true, y_pred, exists (select 1 from acal where acal.anomaly and acal.grp = results.grp and acal.date between target_start and target_end) as anomaly from results")
def c06(spark, sf):
    r = rolling_origin(order_panel(spark, sf), WEEKLY, START, END, (4,))
    return J.flag_windows(r, anomaly_calendar(spark, sf)).select("model", "issue_date", "grp", "y_true", "y_pred", "anomaly")


_USER_FACTS = "f as (select user_id, ts as fact_ts, event_id as fact_id, value as fact_value from events where event_type = 'purchase'), p as (select user_id, ts, event_id from events where event_type <> 'purchase')"


@query("c07_asof_join", f"with {_USER_FACTS} select p.user_id, p.ts, p.event_id, f.fact_ts as matched_fact_ts, f.fact_id, f.fact_value from p asof left join f on f.user_id = p.user_id and f.fact_ts <= p.ts")
def c07(spark, sf):
    ev = table(spark, sf, "events")
    facts = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("fact_ts"), F.col("event_id").alias("fact_id"), F.col("value").alias("fact_value"))
    probes = ev.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return J.asof_join(probes, facts, ["user_id"], "ts", "fact_ts", ["fact_id", "fact_value"], F.date_trunc("day", "__t"))


@query("c07_asof_weekday", f"with {ORDER_PANEL}, v as (select date, grp, isodow(date) as wd, n from panel where n is not null), f as (select date, grp, wd, case when count(n) over w >= 4 then avg(n) over w end as avg_4 from v window w as (partition by grp, wd order by date rows between 3 preceding and current row)), "
       "pr as (select date as target, grp, isodow(date) as wd, date - 3 as cutoff from panel) select pr.grp, cast(pr.wd as bigint) as wd, target, cutoff, f.date as matched_date, avg_4 from pr asof left join f on f.grp = pr.grp and f.wd = pr.wd and f.date <= pr.cutoff")
def c07w(spark, sf):
    from pyspark.sql import Window

    from tallycast.functions.stats import rolling

    p = order_panel(spark, sf).withColumn("wd", iso_weekday(F.col("date")))
    w = Window.partitionBy("grp", "wd").orderBy("date")
    facts = p.where("n is not null").select("date", "grp", "wd", rolling(F.avg, F.col("n"), w, 4, 4).alias("avg_4"))
    probes = p.select(F.col("date").alias("target"), "grp", "wd", F.date_sub("date", 3).alias("cutoff"))
    return J.asof_join(probes, facts, ["grp", "wd"], "cutoff", "date", ["avg_4"])


# --- lag audit ------------------------------------------------------------------------

_LINES = "lines as (select concat_ws(',', event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type) as value from events)"
_DAILY = f"{_LINES}, bd as (select cast(substr(split_part(value, ',', 2), 1, 10) as date) as date, cast(sum(strlen(value) + 1) as bigint) as bytes from lines where length(value) > 0 group by 1)"
_CUM = f"{_DAILY}, cum as (select date, bytes, cast(sum(bytes) over (order by date) as bigint) + 21 as cum_bytes from bd)"
_UP = (f"{_CUM}, up as (select max(ts) + interval 20 hour as uploaded_at, cast(max(event_id) * 33 + 7 as bigint) as size from events group by cast(ts as date), event_type), "
       "cr as (select up.*, arg_min(date, {'d': abs(cum_bytes - size), 'c': cum_bytes}) as content_date from up cross join cum group by uploaded_at, size), "
       "mt as (select uploaded_at, size, content_date, size - cum_bytes as residual, cast(size - cum_bytes as double) / nullif(bytes, 0) as residual_share from cr join cum on cum.date = content_date)")


def event_lines(spark, sf):
    ev = table(spark, sf, "events")
    text = F.concat_ws(",", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type"))
    return ev.select(text.alias("value"))


def uploads(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.to_date("ts").alias("d"), "event_type").agg(
        (F.max("ts") + F.expr("interval 20 hours")).alias("uploaded_at"), (F.max("event_id") * 33 + 7).alias("size")).drop("d", "event_type")


def matched(spark, sf):
    return L.match_uploads(uploads(spark, sf), e14(spark, sf), 20000.0)


@query("a12_bytes_per_day", f"with {_DAILY} select date, bytes from bd")
def a12(spark, sf):
    return L.bytes_per_day(event_lines(spark, sf))


@query("e14_cumulative_bytes", f"with {_CUM} select date, bytes, cum_bytes from cum")
def e14(spark, sf):
    return L.cumulative_bytes(a12(spark, sf), 21)


@query("c09_nearest_value", f"with {_UP} select * from mt")
def c09(spark, sf):
    return matched(spark, sf)


def _avail(h):
    return (f"{_UP}, pd as (select cast(unnest(generate_series((select cast(min(uploaded_at) as date) + 1 from mt)::timestamp, (select cast(max(uploaded_at) as date) from mt)::timestamp, interval 1 day)) as date) as prep_day), "
            f"av as (select prep_day, prep_day + 1 as target_day, max(content_date) as content_date, cast(prep_day + 1 - max(content_date) as bigint) as lag_days from pd join mt on uploaded_at <= cast(prep_day as timestamp) + interval {h} hour group by prep_day)")


@query("c08_availability", f"with {_avail(9)} select * from av")
def c08(spark, sf):
    return L.availability(matched(spark, sf), 9)


@query("l13_lag_distribution", f"with {_avail(17)} select lag_days, count(*) as days, min(prep_day) filter (where lag_days >= 2) as first_worst, cast(count(*) as double) / sum(count(*)) over () as share from av group by lag_days")
def l13(spark, sf):
    return L.lag_distribution(L.availability(matched(spark, sf), 17), 2)


@query("l13_upload_hours", f"with {_UP} select cast(hour(uploaded_at - interval 5 hour) as bigint) as hour, count(*) as uploads from up group by 1")
def l13h(spark, sf):
    """January uploads: the zone is five hours behind UTC on every day of the table."""
    return L.upload_hours(uploads(spark, sf), "America/Toronto")


@query("l13_days_without", "with d as (select distinct cast(o_orderdate as date) as date from orders), s as (select cast(unnest(generate_series((select min(date) from d)::timestamp, (select max(date) from d)::timestamp, interval 1 day)) as date) as date) select date from s where date not in (select date from d)")
def l13d(spark, sf):
    return L.days_without(table(spark, sf, "orders"), F.to_date("o_orderdate"))


@query("l13_residuals", f"with {_UP} select count(*) as uploads, max(abs(residual_share)) as abs_max, min(residual_share) as min, median(residual_share) as median, quantile_cont(abs(residual_share), 0.95) as abs_q95 from mt")
def l13r(spark, sf):
    return L.residual_profile(matched(spark, sf))
