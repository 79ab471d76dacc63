"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import (
    LINE_PANEL, LINE_REC, ORDER_PANEL, ORDER_REC, SUPP_PANEL, TEST_START, line_panel, line_records,
    order_panel, order_records, supplier_panel, table,
)
from tallycast.functions.calendar import month_start
from tallycast.operators import panel as P
from tallycast.operators import profile as R


def _dup(label, keys):
    k = ", ".join(keys)
    return (f"select '{label}' as key_set, cast(sum(c) as bigint) as rows, count(*) as distinct_keys, cast(sum(c - 1) as bigint) as surplus_rows, "
            f"count(*) filter (where c > 1) as repeated_keys from (select {k}, count(*) as c from lineitem group by {k}) t")


_ALL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_SETS = {"full_row": _ALL, "order_line": ("l_orderkey", "l_linenumber"), "order": ("l_orderkey",)}


@query("d06_duplicates", " union all ".join(_dup(k, v) for k, v in _SETS.items()))
def d06(spark, sf):
    return R.duplicate_profile(table(spark, sf, "lineitem"), _SETS)


@query("d07_repeated_ids", "select l_orderkey, count(*) as copies, min(l_shipdate) as first_l_shipdate, arg_min(l_linenumber, {'a': l_shipdate, 'b': l_linenumber}) as first_l_linenumber "
       "from lineitem group by l_orderkey having count(*) > 1 order by copies desc, l_orderkey limit 25")
def d07(spark, sf):
    return R.repeated_ids(table(spark, sf, "lineitem"), "l_orderkey", 25, ["l_shipdate", "l_linenumber"])


_REPORTED = {1996: 2600, 1997: 2500, 1998: 2550, 1999: 2450}
_REP_SQL = " union all ".join(f"select cast({y} as bigint) as year, cast({v} as bigint) as reported" for y, v in _REPORTED.items())
_D08 = ("o as (select cast(year(o_orderdate) as bigint) as year, o_orderkey from orders), t as (select year, count(*) as published, max(o_orderkey) filter (where o_orderkey < 12000) as max_main, "
        f"count(*) filter (where o_orderkey >= 12000) as high_range from o group by year), d08 as (select t.*, reported, cast(published - high_range as double) / nullif(max_main, 0) as share_of_max, "
        f"cast(published as double) / nullif(reported, 0) as share_of_reported from t left join ({_REP_SQL}) r on r.year = t.year)")


@query("d08_numbering_completeness", f"with {_D08} select * from d08")
def d08(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), "o_orderkey")
    rep = spark.createDataFrame(list(_REPORTED.items()), "year bigint, reported bigint")
    return R.numbering_completeness(o, "year", "o_orderkey", 12000, rep)


@query("d09_missing_day_impact", f"with {_D08} select year, published, reported, 100 * (published / 365.0) / nullif(reported, 0) as missing_day_points from d08 where reported is not null")
def d09(spark, sf):
    return R.missing_day_points(d08(spark, sf)).where("reported is not null").select("year", "published", "reported", "missing_day_points")


_NEST = "n as (select o_custkey as child, o_orderpriority as parent, count(*) as c from orders group by 1, 2), p as (select child, count(*) as parents, sum(c) as rows, max(c) as modal_rows from n group by child)"


@query("d10_nesting", f"with {_NEST} select child as o_custkey, parents, cast(rows as bigint) as rows, modal_rows, cast(modal_rows as double) / rows as modal_share from p")
def d10(spark, sf):
    return R.nesting(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("d10_nesting_summary", f"with {_NEST} select count(*) as children, count(*) filter (where parents > 1) as in_several_parents, cast(sum(modal_rows) as double) / sum(rows) as rows_in_modal_parent from p")
def d10s(spark, sf):
    return R.nesting_summary(d10(spark, sf))


_PCOLS = {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}


@query("d11_column_profile", " union all ".join(
    f"select '{c}' as variable, count(*) as rows, count(*) filter (where {c} is null) as nulls, 100.0 * count(*) filter (where {c} is null) / count(*) as null_pct, count(distinct {c}) as \"distinct\", "
    + (f"cast(min({c}) as double) as min, cast(max({c}) as double) as max, cast(null as varchar) as example" if num else f"cast(null as double) as min, cast(null as double) as max, cast(min({c}) as varchar) as example")
    + " from customer" for c, num in _PCOLS.items()))
def d11(spark, sf):
    return R.column_profile(table(spark, sf, "customer"), list(_PCOLS))


@query("d12_yearly_counters", "select cast(year(o_orderdate) as bigint) as year, count(*) as rows, count(*) filter (where o_orderstatus = 'P') as status_p, count(*) filter (where o_totalprice < 10000) as small, "
       "count(*) filter (where o_orderdate = date_trunc('day', o_orderdate)) as date_only, count(distinct o_orderpriority) as n_types from orders group by 1")
def d12(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "P").alias("status_p"), F.count_if(F.col("o_totalprice") < 10000).alias("small"),
        F.count_if(F.col("o_orderdate") == F.date_trunc("day", "o_orderdate")).alias("date_only"), F.count_distinct("o_orderpriority").alias("n_types"))


def _nearest(col, q):
    return f"list_sort(list({col}))[cast(round({q} * (count({col}) - 1)) as integer) + 1]"


@query("d13_load_by_category", f"with t as (select l_returnflag, count(*) as records, sum(l_quantity) as load, avg(l_quantity) as mean_load, max(l_quantity) as max_load, {_nearest('l_quantity', 0.99)} as q_load from lineitem group by 1) "
       "select *, 100.0 * records / sum(records) over () as pct_records, 100.0 * load / sum(load) over () as pct_load from t")
def d13(spark, sf):
    return R.load_by_category(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("d13_price_by_type", f"with b as (select coalesce(p_type, '(blank)') as p_type, l_extendedprice from lineitem join part on p_partkey = l_partkey), t as (select p_type, count(*) as records, sum(l_extendedprice) as load, avg(l_extendedprice) as mean_load, max(l_extendedprice) as max_load, {_nearest('l_extendedprice', 0.99)} as q_load from b group by 1) "
       "select *, 100.0 * records / sum(records) over () as pct_records, 100.0 * load / sum(load) over () as pct_load from t")
def d13b(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.load_by_category(j, "p_type", "l_extendedprice")


@query("d14_top_values", "select p_brand, count(*) as count from part group by 1 order by 2 desc, 1 limit 15")
def d14(spark, sf):
    return R.top_values(table(spark, sf, "part"), "p_brand", 15)


@query("d15_vocabulary_churn", "with s as (select distinct year(o_orderdate) as y, o_custkey as w from orders), b as (select coalesce(a.y, p.y + 1) as period, a.w is not null as cur, p.w is not null as prev from s a full outer join s p on p.y = a.y - 1 and p.w = a.w) "
       "select cast(period as bigint) as period, count(*) filter (where cur) as types, count(*) filter (where cur and not prev) as new, count(*) filter (where prev and not cur) as dropped from b "
       "where period > (select min(y) from s) and period <= (select max(y) from s) group by 1")
def d15(spark, sf):
    return R.vocabulary_churn(table(spark, sf, "orders"), F.year("o_orderdate").cast("bigint"), "o_custkey")


@query("d16_shared_points", "with p as (select l_partkey as x, l_suppkey as y, count(*) as c from lineitem group by 1, 2) select min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, count(*) as distinct_points, "
       "cast(coalesce(sum(c) filter (where c > 1), 0) as double) / sum(c) as rows_on_shared_points from p")
def d16(spark, sf):
    return R.shared_points(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("d17_hour_profile", "select cast(hour(ts) as bigint) as hour, count(*) as rows, 100.0 * count(*) / sum(count(*)) over () as pct from events group by 1")
def d17(spark, sf):
    return R.hour_profile(table(spark, sf, "events"), "ts")


@query("d17_clock_checks", "select count(*) filter (where isodow(ts) = 7 and hour(ts) = 2) as rows_in_gap_hour, count(*) filter (where ts = date_trunc('day', ts)) as rows_at_midnight, count(*) as rows, "
       "count(*) filter (where month(ts) = 3 and isodow(ts) = 7 and day(ts) between 8 and 14 and hour(ts) = 2) as spring_rows from events")
def d17c(spark, sf):
    """Sundays stand in for clock-change days; the real rule finds none in the table's month."""
    ev = table(spark, sf, "events")
    spring = ev.agg(F.count_if(R.spring_forward(F.to_date("ts")) & (F.hour("ts") == 2)).alias("spring_rows"))
    return R.clock_checks(ev, "ts", F.weekday("ts") == 6).withColumn("spring_rows", spring.select("spring_rows").scalar())


def _density(label, src):
    return (f"select '{label}' as grain, count(*) as cells, avg(n) as mean, 100.0 * count(*) filter (where n = 0) / count(*) as pct_zero, 100.0 * count(*) filter (where n <= 5) / count(*) as pct_le_5, "
            f"var_samp(n) / nullif(avg(n), 0) as var_over_mean, median(n) as median from {src} where n is not null")


@query("d18_grain_density", f"with {SUPP_PANEL}, tot as (select date, sum(n) as n from panel group by date) {_density('total x day', 'tot')} union all {_density('supplier x day', 'panel')}")
def d18(spark, sf):
    total = P.single_series(line_records(spark, sf, "l_suppkey"))
    return R.grain_density(total, "total x day").unionByName(R.grain_density(supplier_panel(spark, sf), "supplier x day"))


@query("d19_target_distribution", f"with {LINE_PANEL}, k as (select * from panel where n is not null), m as (select grp, avg(n) as mu from k group by grp), z as (select k.grp, avg((n-mu)^2) as m2, avg((n-mu)^3) as m3, avg((n-mu)^4) as m4 from k join m on m.grp = k.grp group by k.grp), "
       f"t as (select grp, count(*) as days, avg(n) as mean, stddev_samp(n) as sd, min(n) as min, cast({_nearest('n', 0.05)} as double) as p5, cast({_nearest('n', 0.25)} as double) as q1, median(n) as median, cast({_nearest('n', 0.75)} as double) as q3, cast({_nearest('n', 0.95)} as double) as p95, max(n) as max from k group by grp) "
       "select t.*, m3 / m2^1.5 as skewness, m4 / m2^2 - 3 as excess_kurtosis from t join z on z.grp = t.grp")
def d19(spark, sf):
    return R.target_distribution(line_panel(spark, sf))


@query("d20_yearly_means", f"with {ORDER_PANEL} select cast(year(date) as bigint) as year, avg(n) as mean_per_day, count(*) as days from panel where n is not null group by 1")
def d20(spark, sf):
    return R.yearly_means(order_panel(spark, sf))


@query("d21_weekly_means", f"with {ORDER_PANEL} select grp, cast(date_trunc('week', date) as date) as week, avg(n) as n from panel where n is not null group by 1, 2")
def d21(spark, sf):
    return R.weekly_means(order_panel(spark, sf))


_LABELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "other / blank")


@query("d22_monthly_composition", "with d as (select cast(o_orderdate as date) as d, case when o_orderpriority in ('1-URGENT','2-HIGH','3-MEDIUM') then o_orderpriority else 'other / blank' end as l, count(*) as c from orders group by 1, 2) select cast(date_trunc('month', d) as date) as month, "
       + ", ".join(f"coalesce(cast(sum(c) filter (where l = '{x}') as double) / nullif(count(*) filter (where l = '{x}'), 0), 0) as \"{x}\"" for x in _LABELS) + " from d group by 1")
def d22(spark, sf):
    o = table(spark, sf, "orders")
    label = F.when(F.col("o_orderpriority").isin(*_LABELS[:3]), F.col("o_orderpriority")).otherwise("other / blank")
    return R.monthly_composition(o, F.col("o_orderdate"), label, _LABELS)


@query("d23_same_span_change", f"with {ORDER_REC} select grp, sub, count(*) filter (where year(date) = 2000) as n_first, count(*) filter (where year(date) = 2001) as n_last, "
       "100 * (cast(count(*) filter (where year(date) = 2001) as double) / nullif(count(*) filter (where year(date) = 2000), 0) - 1) as pct_change from rec where year(date) in (2000, 2001) and dayofyear(date) <= 200 group by grp, sub")
def d23(spark, sf):
    return R.same_span_change(order_records(spark, sf), F.col("date"), ["grp", "sub"], 2000, 2001, 200)


@query("d24_seasonal_index", f"with {ORDER_PANEL}, d as (select grp, n, cast(isodow(date) as bigint) as weekday, cast(month(date) as bigint) as month from panel where n is not null), "
       "a as (select grp, weekday, null::bigint as month, avg(n) as mean_n from d group by grp, weekday), b as (select grp, null::bigint as weekday, month, avg(n) as mean_n from d group by grp, month), c as (select grp, weekday, month, avg(n) as mean_n from d group by all), g as (select grp, avg(n) as m from d group by grp) "
       "select grp, weekday, month, mean_n, mean_n / avg(mean_n) over (partition by grp) as index from a union all select grp, weekday, month, mean_n, mean_n / avg(mean_n) over (partition by grp) from b union all select c.grp, weekday, month, mean_n, mean_n / m from c join g on g.grp = c.grp")
def d24(spark, sf):
    return R.seasonal_index(order_panel(spark, sf))


@query("d29_series_correlation", f"with {LINE_PANEL}, w as (select date, " + ", ".join(f"max(n) filter (where grp = {k}) as g{k}" for k in range(1, 8)) + " from panel group by date) "
       + " union all ".join(f"select 'g{a}' as \"left\", 'g{b}' as \"right\", corr(g{a}, g{b}) as corr from w" for a in range(1, 8) for b in range(a + 1, 8)))
def d29(spark, sf):
    names = [f"g{k}" for k in range(1, 8)]
    wide = line_panel(spark, sf).groupBy("date").pivot("grp", list(range(1, 8))).agg(F.max("n")).toDF("date", *names)
    return R.pairwise_correlation(wide, names)


@query("d30_low_spell", f"with {ORDER_PANEL} select grp, min(date) as first_day, max(date) as last_day, count(*) as days from panel where n < 1 and year(date) = 1997 group by grp")
def d30(spark, sf):
    return R.low_activity(order_panel(spark, sf), 1997, 1)


_SCHED = (f"{ORDER_PANEL}, k as (select * from panel where n is not null), m as (select cast(unnest(generate_series(timestamp '1997-01-01', timestamp '1999-12-01', interval 1 month)) as date) as validation_start), "
          "sch as (select validation_start, last_day(validation_start) as validation_end, validation_start - 3 as training_cutoff, (select count(*) from k where date <= validation_start - 3) as training_rows, "
          "(select count(*) from k where date between validation_start and last_day(validation_start)) as validation_rows, (select max(date) from k where date <= validation_start - 3) as latest_training_date, "
          "(select min(date) from k where date between validation_start and last_day(validation_start)) as first_valid from m)")


@query("d31_expanding_counts", f"with {_SCHED} select * from sch")
def d31(spark, sf):
    return R.expanding_counts(order_panel(spark, sf), "1997-01-01", "1999-12-01")


@query("h13_schedule_checks", f"with {_SCHED} select validation_start, training_cutoff, latest_training_date, training_rows, validation_rows, latest_training_date = training_cutoff as cutoff_correct, latest_training_date < first_valid as no_overlap, "
       f"latest_training_date < date '{TEST_START}' and validation_end < date '{TEST_START}' as test_excluded from sch")
def h13(spark, sf):
    return R.schedule_checks(d31(spark, sf), TEST_START)


@query("d32_group_and_all", "select coalesce(o_orderpriority, 'All') as o_orderpriority, count(*) as n, avg(o_totalprice) as mean_price, max(o_totalprice) as max_price from orders group by grouping sets ((o_orderpriority), ())")
def d32(spark, sf):
    return R.with_all_row(table(spark, sf, "orders"), "o_orderpriority", [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price")])


@query("d33_freshness", "select cast(max(ts) as date) as last_day, cast(date '2024-02-15' - cast(max(ts) as date) as bigint) as lag_days from events")
def d33(spark, sf):
    return R.freshness(table(spark, sf, "events"), "ts", "2024-02-15")


@query("d34_outside_groups", "select cast(year(l_shipdate) as bigint) as year, l_returnflag as category, count(*) as n, avg(l_quantity) as mean_load from lineitem where l_linenumber not in (1,2,3) group by 1, 2")
def d34(spark, sf):
    return table(spark, sf, "lineitem").where(~F.col("l_linenumber").isin(1, 2, 3)).groupBy(
        F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_returnflag").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_load"))


@query("d34_outside_top", "select p_brand, count(*) as count from lineitem join part on p_partkey = l_partkey where l_linenumber > 5 group by 1 order by 2 desc, 1 limit 5")
def d34b(spark, sf):
    j = table(spark, sf, "lineitem").where("l_linenumber > 5").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.top_values(j, "p_brand", 5)


@query("d35_recent_snapshot", f"with {LINE_PANEL} select date, " + ", ".join(f"max(n) filter (where grp = {k}) as \"{k}\"" for k in range(1, 8)) + " from panel where date > (select max(date) from panel) - 7 group by date")
def d35(spark, sf):
    return R.recent_snapshot(line_panel(spark, sf), 7, list(range(1, 8)))


@query("g03_set_operations", "with a as (select distinct o_custkey as k from orders where year(o_orderdate) = 1996), b as (select distinct o_custkey as k from orders where year(o_orderdate) = 1997) "
       "select 'union' as op, count(*) as n from (select k from a union select k from b) union all select 'intersect', count(*) from (select k from a intersect select k from b) union all select 'except', count(*) from (select k from a except select k from b)")
def g03(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k")).distinct() for y in (1996, 1997))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    return R.append_all([d.agg(F.lit(k).alias("op"), F.count(F.lit(1)).alias("n")) for k, d in ops.items()])


@query("g04_append_compatibility", "with a as (select * from orders where o_orderdate < timestamp '1998-07-01'), b as (select * from orders where o_orderdate >= timestamp '1998-07-01') select true as same_columns, "
       "(select max(o_orderdate) from a) >= (select min(o_orderdate) from b) as date_overlap, (select count(*) from (select o_orderkey from a intersect select o_orderkey from b)) as key_overlap")
def g04(spark, sf):
    from tallycast.sources.records import append_checks

    o, cut = table(spark, sf, "orders"), F.lit("1998-07-01").cast("timestamp_ntz")
    return append_checks(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_orderdate", ["o_orderkey"])


@query("g05_pivot_unpivot", "with p as (select cast(year(o_orderdate) as bigint) as year, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1) "
       "select year, 'f' as status, f as n from p union all select year, 'o', o from p union all select year, 'p', p from p")
def g05(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).toDF("year", "f", "o", "p")
    return wide.unpivot("year", ["f", "o", "p"], "status", "n")


@query("b10_name_numbers", "select p_brand, cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) as number, count(*) as n from part where p_brand like 'Brand#1%' group by all")
def b10(spark, sf):
    from tallycast.operators.metrics import window_length

    p = table(spark, sf, "part").where(F.col("p_brand").startswith("Brand#1"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("number", window_length(F.col("p_brand")))


@query("b11_recode", "select case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' else o_orderpriority end as label, count(*) as n from orders group by 1")
def b11(spark, sf):
    from tallycast.sources.records import recode

    return table(spark, sf, "orders").groupBy(recode(F.col("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"}).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_label_map", "select coalesce(case p_type when 'ECONOMY' then 'ECO' when 'STANDARD' then 'STD' when 'PROMO' then '(blank)' end, p_type) as code, count(*) as n, count(distinct p_brand) as brands from part group by 1")
def a15(spark, sf):
    from tallycast.sources.records import harmonise

    p = table(spark, sf, "part").withColumn("p_type", F.nullif(F.col("p_type"), F.lit("PROMO")))
    return harmonise(p, "p_type", {"ECONOMY": "ECO", "STANDARD": "STD"}).groupBy(F.col("p_type").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))
