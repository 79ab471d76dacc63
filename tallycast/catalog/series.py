"""Series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog import query
from tallycast.catalog.inputs import LINE_PANEL, ORDER_PANEL, SERIES_SQL, line_panel, order_panel, supplier_panel
from tallycast.operators import anomalies as A
from tallycast.operators import decompose as D
from tallycast.operators import series as S

_KNOWN = "k as (select grp, date, cast(n as double) as n, row_number() over (partition by grp order by date) as rn from panel where n is not null), e as (select grp, rn, n - avg(n) over (partition by grp) as d from k)"



def _acf_ctes(lags: int) -> str:
    return (f"{LINE_PANEL}, {_KNOWN}, s0 as (select grp, sum(d*d) as s from e group by grp), "
            f"ac as (select a.grp, a.rn - b.rn as lag, sum(a.d * b.d) as s from e a join e b on b.grp = a.grp and a.rn - b.rn between 0 and {lags} group by 1, 2), "
            "acf as (select ac.grp, lag, ac.s / nullif(s0.s, 0) as acf from ac join s0 on s0.grp = ac.grp)")


@query("q01_acf", f"with {_acf_ctes(28)} select * from acf")
def q01(spark, sf):
    return S.acf(line_panel(spark, sf), 28)


# The Durbin-Levinson recursion, a row a lag: r[i + 1] is the autocorrelation at lag i, phi the coefficients so far.
_PACF = (f"with recursive {_acf_ctes(42)}, r as (select grp, list(acf order by lag) as r from acf group by grp), "
         "lev as (select grp, r, cast(1 as bigint) as lag, r[2] as pacf, [r[2]] as phi, 1 - r[2] * r[2] as v from r "
         "union all select grp, r, lag + 1, a, list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - a * phi[lag + 1 - j]), a), v * (1 - a * a) from ("
         "select *, (r[lag + 2] - list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[lag + 2 - j]))) / v as a from lev where lag < 42)) "
         "select grp, lag, pacf from lev union all select grp, cast(0 as bigint), 1.0 from r")


@query("q02_pacf", _PACF)
def q02(spark, sf):
    return S.pacf(line_panel(spark, sf), 42)


@query("q03_adf")
def q03(spark, sf):
    return S.adf(line_panel(spark, sf))


@query("q04_kpss", f"with {LINE_PANEL}, {_KNOWN}, m as (select grp, cast(count(*) as double) as m, sum(d*d) as c0 from e group by grp), "
       "cx as (select a.grp, a.rn - b.rn as k, sum(a.d * b.d) as c from e a join e b on b.grp = a.grp and a.rn - b.rn between 1 and 100 group by 1, 2), "
       "s as (select m.grp, m.m, c0, c0 / m.m + sum(2 * c / m.m) filter (where k <= floor(m.m^(2.0/9))) as s0, sum(2 * k * c / m.m) filter (where k <= floor(m.m^(2.0/9))) as s1 from m join cx on cx.grp = m.grp group by m.grp, m.m, c0), "
       "l as (select *, least(cast(floor(1.1447 * ((s1/s0)^2)^(1.0/3) * m^(1.0/3)) as bigint), cast(m as bigint) - 1) as lags from s), "
       "v as (select l.grp, l.m, lags, (c0 + 2 * coalesce(sum((1 - k / (lags + 1.0)) * c) filter (where k <= lags), 0)) / l.m as var from l join cx on cx.grp = l.grp group by l.grp, l.m, lags, c0), "
       "cs as (select grp, sum(d) over (partition by grp order by rn) as c from e), ss as (select grp, sum(c*c) as s from cs group by grp), st as (select v.grp, lags, ss.s / m / m / var as statistic from v join ss on ss.grp = v.grp) "
       "select grp, lags, statistic, case when statistic <= 0.347 then 0.10 when statistic >= 0.739 then 0.01 when statistic < 0.463 then 0.10 - (statistic - 0.347) / (0.463 - 0.347) * 0.05 when statistic < 0.574 then 0.05 - (statistic - 0.463) / (0.574 - 0.463) * 0.025 else 0.025 - (statistic - 0.574) / (0.739 - 0.574) * 0.015 end as p_value from st")
def q04(spark, sf):
    return S.kpss(line_panel(spark, sf))


@query("q05_dispersion", f"with {LINE_PANEL} select grp, avg(n) as mean, var_samp(n) / nullif(avg(n), 0) as var_over_mean from panel where n is not null group by grp")
def q05(spark, sf):
    return S.dispersion(line_panel(spark, sf))


@query("q06_decompose")
def q06(spark, sf):
    return D.decompose(line_panel(spark, sf))


@query("q06_decompose_many_series")
def q06m(spark, sf):
    """Strengths of every supplier series: one task per series."""
    return D.strengths(D.decompose(supplier_panel(spark, sf)))


@query("q07_anomaly_calendar")
def q07(spark, sf):
    """The full anomaly calendar: decomposition, robust z, flag."""
    return A.robust_z(D.decompose(line_panel(spark, sf)).select("date", "grp", "n", "resid"))


def _polish_sql(rounds: int) -> str:
    """Alternating medians written out, two sweeps a round; sweeps after the last that moves anything change nothing."""
    ctes = ["p0 as materialized (select date_trunc('month', date) as month, grp, ln(avg(n)) as resid, 0.0::double as o, 0.0::double as em, 0.0::double as eg from panel where n is not null group by 1, 2 having avg(n) > 0)"]
    for i in range(2 * rounds):
        key, own, other, okey = ("month", "em", "eg", "grp") if i % 2 == 0 else ("grp", "eg", "em", "month")
        ctes.append(
            f"p{i + 1} as materialized (select p.month, p.grp, p.resid - m.m as resid, p.o + s.s as o, p.{own} + m.m as {own}, p.{other} - s.s as {other} from p{i} p "
            f"join (select {key}, median(resid) as m from p{i} group by {key}) m on m.{key} = p.{key}, "
            f"(select median(x) as s from (select {okey}, any_value({other}) as x from p{i} group by {okey})) s)")
    return (f"with {LINE_PANEL}, {', '.join(ctes)}, f as (select * from p{2 * rounds}), "
            "v as (select (select var_pop(e) from (select month, any_value(em) as e from f group by month)) as vm, (select var_pop(resid) from f) as vr) "
            "select grp, exp(any_value(o)) as overall_per_day, 100 * (exp(any_value(eg)) - 1) as group_effect_pct, "
            "100 * (exp(avg(resid) filter (where month >= date '2001-01-01')) - 1) as late_residual_pct, any_value(vm / nullif(vm + vr, 0)) as shared_share from f, v group by grp")


@query("q08_median_polish", _polish_sql(20))
def q08(spark, sf):
    return D.polish_summary(D.median_polish(D.monthly_log_table(line_panel(spark, sf))), "2001-01-01")


_GAP = "g as (select date, grp, case when n > 0 then n end as v from panel)"
_PN = ("pn as (select date, grp, v, last_value(case when v is not null then date end ignore nulls) over (partition by grp order by date rows between unbounded preceding and current row) as pd, last_value(v ignore nulls) over (partition by grp order by date rows between unbounded preceding and current row) as pv, "
       "first_value(case when v is not null then date end ignore nulls) over (partition by grp order by date rows between current row and unbounded following) as qd, first_value(v ignore nulls) over (partition by grp order by date rows between current row and unbounded following) as qv from g)")


@query("e17_fill_and_interpolate", f"with {ORDER_PANEL}, {_GAP}, {_PN} select date, grp, pv as filled, coalesce(cast(v as double), case when pd is not null and qd is not null then pv + (qv - pv) * cast(date - pd as double) / nullif(qd - pd, 0) end) as inner_fit, "
       "coalesce(cast(v as double), case when pd is not null and qd is not null then pv + (qv - pv) * cast(date - pd as double) / nullif(qd - pd, 0) end, cast(pv as double), cast(qv as double)) as edge_fit from pn")
def e17(spark, sf):
    g = order_panel(spark, sf).select("date", "grp", F.when(F.col("n") > 0, F.col("n")).alias("v"))
    both = S.interpolate(S.interpolate(g.withColumn("filled", S.forward_fill("v")), "v", "inner_fit"), "v", "edge_fit", edges=True)
    return both.select("date", "grp", "filled", "inner_fit", "edge_fit")


@query("e18_log_series", f"with {ORDER_PANEL}, b as (select grp, min(date) filter (where n > 0) as a, max(date) filter (where n > 0) as z from panel group by grp) select date, panel.grp, case when n > 0 then ln(n) end as y from panel join b on b.grp = panel.grp and date between a and z")
def e18(spark, sf):
    return S.log_series(order_panel(spark, sf))
