"""Panel, contract, calendar and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import (
    LINE_KEEP, LINE_PANEL, LINE_REC, ORDER_KEEP, ORDER_PANEL, ORDER_REC, FLAG_REC, SUPP_PANEL,
    TEST_START, VALIDATION, days_sql, line_panel, line_records, order_panel, order_records, panel_ctes,
    staged, supplier_panel, table,
)
from tallycast.functions import calendar as cal
from tallycast.operators import panel as P


@query("d01_daily_counts", f"with {panel_ctes(FLAG_REC)} select date, grp, n from panel")
def d01(spark, sf):
    return P.daily_panel(line_records(spark, sf, "l_returnflag")).select("date", "grp", "n")


@query("d01_single_series", f"with {ORDER_REC}, cal as ({days_sql('(select min(date) from rec)', '(select max(date) from rec)')}), "
       "c as (select date, count(*) as n from rec group by date) select cal.date, c.n from cal left join c on c.date = cal.date")
def d01b(spark, sf):
    return P.single_series(order_records(spark, sf))


@query("d02_panel_subset", f"with {ORDER_PANEL} select date, grp, n, n_sub from panel")
def d02(spark, sf):
    return order_panel(spark, sf)


_KEEP = (1, 3, 9)


@query("d02_panel_kept_groups", f"with {panel_ctes(ORDER_REC, _KEEP)} select date, grp, n, n_sub from panel")
def d02k(spark, sf):
    return P.daily_panel(order_records(spark, sf), _KEEP)


@query("d03_panel_totals", f"with {ORDER_PANEL}, p as (select grp, count(*) as days, cast(sum(n) as bigint) as panel_total from panel group by grp), "
       "r as (select grp, count(*) as record_total from rec group by grp) "
       "select p.grp, days, panel_total, record_total, panel_total = record_total as preserved from p left join r on r.grp = p.grp")
def d03(spark, sf):
    recs = order_records(spark, sf)
    totals = recs.groupBy("grp").agg(F.count(F.lit(1)).alias("record_total"))
    p = P.daily_panel(recs, ORDER_KEEP).groupBy("grp").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("panel_total"))
    return p.join(totals, "grp", "left").withColumn("preserved", F.col("panel_total") == F.col("record_total"))


@query("d04_coverage", f"with {ORDER_PANEL} select grp, count(*) as days, count(n) as observed_days, "
       "count(*) filter (where n is null) as missing_days, cast(sum(n) as bigint) as total from panel group by grp")
def d04(spark, sf):
    return P.coverage(order_panel(spark, sf))


_VIOL = """with {panel}, k as (select grp, date, count(*) as c, count(*) filter (where (n is null) <> (n_sub is null)) as mis,
count(*) filter (where n_sub > n) as exc from panel group by grp, date),
g as (select grp, count(*) filter (where c > 1) as dup, cast(sum(c) <> max(date) - min(date) + 1 as bigint) as gap,
sum(mis) as mis, sum(exc) as exc from k group by grp)
select cast(sum(dup) as bigint) as duplicate_keys, cast(sum(gap) as bigint) as groups_with_gaps,
cast(sum(mis) as bigint) as misaligned_subset, cast(sum(exc) as bigint) as subset_exceeds_total from g"""


@query("d05_panel_contract", _VIOL.format(panel=ORDER_PANEL))
def d05(spark, sf):
    return P.contract_violations(order_panel(spark, sf))


@query("d05_contract_breaches", _VIOL.format(
    panel="panel as (select cast(l_shipdate as date) as date, l_suppkey as grp, count(*) as n, "
          "case when min(l_quantity) > 2 then count(*) filter (where l_tax > 0.01) * 2 end as n_sub "
          "from lineitem group by 1, 2 union all select cast(l_shipdate as date), l_suppkey, 1, 1 from lineitem where l_quantity = 50)"))
def d05b(spark, sf):
    """The contract on a deliberately raw table: sparse days, repeated keys, odd subsets."""
    li = table(spark, sf, "lineitem")
    day, g = F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("grp")
    a = li.groupBy(day, g).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.min("l_quantity") > 2, F.count_if(F.col("l_tax") > 0.01) * 2).alias("n_sub"),
    )
    b = li.where("l_quantity = 50").select(day, g, F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_sub"))
    return P.contract_violations(a.unionByName(b))


@query("c01_calendar_groups", f"with {ORDER_PANEL} select grp, count(*) as cells, min(date) as first_day, max(date) as last_day from panel group by grp")
def c01(spark, sf):
    return order_panel(spark, sf).groupBy("grp").agg(
        F.count(F.lit(1)).alias("cells"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("c02_densify_suppliers", f"with {SUPP_PANEL} select grp, count(*) as cells, count(*) filter (where n = 0) as zero_cells, cast(sum(n) as bigint) as total from panel group by grp")
def c02(spark, sf):
    return supplier_panel(spark, sf).groupBy("grp").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") == 0).alias("zero_cells"), F.sum("n").alias("total"))


@query("c05_missing_days", f"with {ORDER_REC}, cal as ({days_sql('(select min(date) from rec)', '(select max(date) from rec)')}) "
       "select date from cal where date not in (select date from rec)")
def c05(spark, sf):
    seen = P.observed_dates(order_records(spark, sf))
    cal_days = seen.agg(F.sequence(F.min("date"), F.max("date")).alias("d")).select(F.explode("d").alias("date"))
    return cal_days.join(seen, "date", "left_anti")


@query("c05_unlabelled_documents", "select source, count(*) as documents from documents "
       "where doc_id not in (select doc_id from labels) group by source")
def c05b(spark, sf):
    """Keys of one table that another never mentions."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("d25_total_series", f"with {ORDER_PANEL} select date, cast(0 as bigint) as grp, "
       "case when count(n) = (select count(distinct grp) from panel) then cast(sum(n) as bigint) end as n, "
       "case when count(n) = (select count(distinct grp) from panel) then cast(sum(n_sub) as bigint) end as n_sub from panel group by date")
def d25(spark, sf):
    return P.total_series(order_panel(spark, sf), n_groups=len(ORDER_KEEP))


@query("d26_group_shares", f"with {ORDER_PANEL}, ok as (select date, count(n) = (select count(distinct grp) from panel) as ok from panel group by date), "
       "m as (select panel.date, grp, case when ok then n end as n from panel join ok on ok.date = panel.date), "
       "s as (select date, grp, sum(n) over w as s, count(n) over w as k from m window w as (partition by grp order by date rows between 27 preceding and current row)), "
       "t as (select date, sum(s) as t from s group by date) "
       "select s.date as cutoff, grp, case when k >= 20 then cast(s as double) / nullif(t, 0) end as share from s join t on t.date = s.date")
def d26(spark, sf):
    return P.group_shares(staged(order_panel(spark, sf)), 28, 20, len(ORDER_KEEP))


# --- scans and appends over the driver tables ----------------------------------------

@query("a02_append_exports", "select cast(year(d) as bigint) as year, src, count(*) as n from ("
       "select o_orderdate as d, 'early' as src from orders where o_orderdate < timestamp '1998-07-01' union all "
       "select o_orderdate, 'late' from orders where o_orderdate >= timestamp '1998-07-01') group by 1, 2")
def a02(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    early = o.where(F.col("o_orderdate") < cut).select("o_orderdate", F.lit("early").alias("src"))
    late = o.where(F.col("o_orderdate") >= cut).select("o_orderdate", F.lit("late").alias("src"))
    return early.unionByName(late).groupBy(F.year("o_orderdate").cast("bigint").alias("year"), "src").agg(F.count(F.lit(1)).alias("n"))


@query("a03_relaxed_append", "select cast(c_nationkey as bigint) as nation, src, count(*) as n, count(segment) as segments, sum(bal) as balance from ("
       "select c_nationkey, c_mktsegment as segment, c_acctbal as bal, 'customer' as src from customer union all "
       "select s_nationkey, null, s_acctbal, 'supplier' from supplier) group by 1, 2")
def a03(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"),
                                            F.col("c_acctbal").alias("bal"), F.lit("customer").alias("src"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("src"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("nation", "src").agg(
        F.count(F.lit(1)).alias("n"), F.count("segment").alias("segments"), F.sum("bal").alias("balance"))


@query("b01_membership_filter", f"with {LINE_REC} select count(*) filter (where grp in (1,2,3)) as kept, "
       "count(*) filter (where grp not in (1,2,3) or grp is null) as excluded, count(*) as total from rec")
def b01(spark, sf):
    inside = F.coalesce(F.col("grp").isin(1, 2, 3), F.lit(False))
    return line_records(spark, sf).agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("excluded"), F.count(F.lit(1)).alias("total"))


@query("b02_date_range", f"with {ORDER_PANEL} select grp, count(*) as days, cast(sum(n) as bigint) as total from panel "
       f"where date between date '{VALIDATION[0]}' and date '{VALIDATION[1]}' group by grp")
def b02(spark, sf):
    return order_panel(spark, sf).where(F.col("date").between(F.lit(VALIDATION[0]).cast("date"), F.lit(VALIDATION[1]).cast("date"))).groupBy("grp").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("total"))


@query("b03_chronological_split", f"with {ORDER_PANEL} select case when date < date '{VALIDATION[0]}' then 'context' "
       f"when date <= date '{VALIDATION[1]}' then 'development' else 'test' end as part, count(*) as n_rows, "
       "count(n) as known, (select count(*) from panel) as all_rows from panel group by 1")
def b03(spark, sf):
    p = order_panel(spark, sf)
    part = F.when(F.col("date") < F.lit(VALIDATION[0]).cast("date"), "context").when(
        F.col("date") <= F.lit(VALIDATION[1]).cast("date"), "development").otherwise("test")
    return p.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("known")).withColumn(
        "all_rows", p.select(F.count(F.lit(1))).scalar())


@query("b04_rare_bucket", "select case when p_type in ('ECONOMY','STANDARD') then p_type else 'other / blank' end as kind, "
       "coalesce(nullif(p_brand, 'Brand#1'), '(blank)') as brand, count(*) as n from part group by 1, 2")
def b04(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), F.col("p_type")).otherwise("other / blank")
    brand = F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.lit("(blank)"))
    return p.groupBy(kind.alias("kind"), brand.alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("b05_date_parts", "select distinct cast(o_orderdate as date) as date, cast(year(o_orderdate) as bigint) as year, cast(month(o_orderdate) as bigint) as month, "
       "cast(isodow(o_orderdate) as bigint) as weekday, cast(dayofyear(o_orderdate) as bigint) as doy, cast(date_trunc('month', o_orderdate) as date) as month_start, "
       "strftime(o_orderdate, '%Y-%m') as year_month, strftime(o_orderdate, '%a') as day_name, "
       "cast(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) as bigint) as iso_week from orders")
def b05(spark, sf):
    d = F.col("date")
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().select(
        "date", F.year(d).cast("bigint").alias("year"), F.month(d).cast("bigint").alias("month"), cal.iso_weekday(d).alias("weekday"),
        F.dayofyear(d).cast("bigint").alias("doy"), cal.month_start(d).alias("month_start"), cal.year_month(d).alias("year_month"),
        F.date_format(d, "EEE").alias("day_name"), cal.week_key(d).alias("iso_week"))
