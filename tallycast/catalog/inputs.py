"""Driver tables in the roles of event records and panels, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.panel import daily_panel, records
from tallycast.sources.sinks import stage
from tallycast.spec import Setting, min_samples

# Spans of the 1995-2001 tables: context, validation, scored part, held-out test.
VALIDATION = ("1996-01-01", "1999-12-31")
SCORED = ("1997-01-01", "1999-12-31")
TEST_START = "2000-01-01"
TEST_END = "2001-11-04"  # last day of the panel
BREAK_DATE = "2000-10-01"

LINE_KEEP = (1, 2, 3, 4, 5, 6, 7)
ORDER_KEEP = (1, 2, 3, 4, 5)


def months_between(start: str, end: str) -> tuple[str, ...]:
    """First days of the months of a period that begins with a month."""
    (y, m), (last_y, last_m) = (map(int, d.split("-")[:2]) for d in (start, end))
    return tuple(f"{k // 12}-{k % 12 + 1:02d}-01" for k in range(y * 12 + m - 1, last_y * 12 + last_m))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_records(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return records(o, F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("bigint"), F.col("o_orderstatus") == "F")


def line_records(spark, sf, group: str = "l_linenumber") -> DataFrame:
    li = table(spark, sf, "lineitem")
    g = F.col(group) if group == "l_returnflag" else F.col(group).cast("bigint")
    return records(li, F.col("l_shipdate"), g, F.col("l_linestatus") == "F")


def order_panel(spark, sf) -> DataFrame:
    return daily_panel(order_records(spark, sf), ORDER_KEEP)


def line_panel(spark, sf) -> DataFrame:
    return daily_panel(line_records(spark, sf), LINE_KEEP)


def supplier_panel(spark, sf) -> DataFrame:
    return daily_panel(line_records(spark, sf, "l_suppkey"))


def staged(panel: DataFrame) -> DataFrame:
    """Written once to the shared folder, for queries that read the panel several times."""
    return stage(panel, "panel")


# --- SQL side ------------------------------------------------------------------------

ORDER_REC = (
    "rec as (select cast(o_orderdate as date) as date, cast(substr(o_orderpriority,1,1) as bigint) as grp, "
    "o_orderstatus = 'F' as sub from orders)"
)
LINE_REC = (
    "rec as (select cast(l_shipdate as date) as date, cast(l_linenumber as bigint) as grp, "
    "l_linestatus = 'F' as sub from lineitem)"
)
FLAG_REC = (
    "rec as (select cast(l_shipdate as date) as date, l_returnflag as grp, l_linestatus = 'F' as sub from lineitem)"
)
SUPP_REC = (
    "rec as (select cast(l_shipdate as date) as date, l_suppkey as grp, l_linestatus = 'F' as sub from lineitem)"
)


def days_sql(lo: str, hi: str) -> str:
    return (f"select cast(t as date) as date from (select unnest(generate_series(cast({lo} as timestamp), "
            f"cast({hi} as timestamp), interval 1 day)) as t)")


def panel_ctes(rec: str, keep=None) -> str:
    """CTEs ending in ``panel(date, grp, n, n_sub)``."""
    groups = (
        "select distinct grp from rec where grp is not null"
        if keep is None
        else "select cast(g as bigint) as grp from (values " + ",".join(f"({k})" for k in keep) + ") v(g)"
    )
    return (
        f"{rec}, cal as ({days_sql('(select min(date) from rec)', '(select max(date) from rec)')}), "
        f"groups as ({groups}), obs as (select distinct date from rec), "
        "cnt as (select date, grp, count(*) as n, count(*) filter (where sub) as n_sub from rec group by date, grp), "
        "panel as (select cal.date, groups.grp, "
        "case when obs.date is not null then coalesce(cnt.n, 0) end as n, "
        "case when obs.date is not null then coalesce(cnt.n_sub, 0) end as n_sub "
        "from cal cross join groups left join obs on obs.date = cal.date "
        "left join cnt on cnt.date = cal.date and cnt.grp = groups.grp)"
    )


ORDER_PANEL = panel_ctes(ORDER_REC, ORDER_KEEP)
LINE_PANEL = panel_ctes(LINE_REC, LINE_KEEP)
SUPP_PANEL = panel_ctes(SUPP_REC)


def roll(fn: str, col: str, size: int, need: int, end: int = 0) -> str:
    """Gated rolling statistic over the series window, as SQL."""
    a, b = -(end - size + 1), -end
    frame = f"over (partition by grp order by date rows between {a} preceding and {b} preceding)"
    return f"case when count({col}) {frame} >= {need} then {fn}({col}) {frame} end"


def same_weekday_sql(s: Setting, weeks: int, need: int | None = None) -> str:
    need = min_samples(weeks) if need is None else need
    days = []
    for j in range(s.window_days):
        ahead = s.gap_days + j
        first = -(-ahead // 7)
        lags = [f"lag(n, {7 * k - ahead}) over w" for k in range(first, first + weeks)]
        arr = "list_value(" + ", ".join(lags) + ")"
        days.append(f"(case when list_count({arr}) >= {need} then list_avg({arr}) end)")
    return "((" + " + ".join(days) + f") / {float(s.window_days)})"


def forward_sql(s: Setting) -> str:
    frame = f"over (partition by grp order by date rows between {s.gap_days} following and {s.gap_days + s.window_days - 1} following)"
    return f"case when count(n) {frame} = {s.window_days} then cast(sum(n) {frame} as double) end"


SERIES_SQL = "window w as (partition by grp order by date)"


def timing_sql(s: Setting, cut: str = "date") -> str:
    return (
        f"{cut} + {s.publication_lag_days} as issue_date, {cut} as cutoff, "
        f"{cut} + {s.gap_days} as target_start, {cut} + {s.gap_days + s.window_days - 1} as target_end"
    )


def schedule_sql(s: Setting, start: str, end: str) -> str:
    first = f"date '{start}'"
    if s.window_days == 7:
        first = f"(date '{start}' + cast((8 - isodow(date '{start}')) % 7 as integer))"
    return (f"target_start >= {first} and target_end <= date '{end}' "
            f"and (target_start - {first}) % {s.window_days} = 0")


def results_ctes(panel: str, s: Setting, start: str, end: str, weeks=(4, 8, 13, 26, 52), plain=(28,)) -> str:
    """CTEs ending in ``results``: baseline prediction rows of a rolling-origin run."""
    cols = {f"same_wd_{k}w": f"{same_weekday_sql(s, k)} * {s.window_days}" for k in weeks}
    cols |= {f"plain_{d}d": f"({roll('avg', 'n', d, min_samples(d))}) * {s.window_days}" for d in plain}
    exprs = ", ".join(f"{e} as {k}" for k, e in cols.items())
    union = " union all ".join(
        f"select '{s.key}' as spec, '{m}' as model, issue_date, cutoff, target_start, target_end, grp, y_true, "
        f"cast({m} as double) as y_pred from wide where {schedule_sql(s, start, end)}" for m in cols
    )
    return (
        f"{panel}, wide as (select date, grp, {timing_sql(s)}, {forward_sql(s)} as y_true, {exprs} from panel {SERIES_SQL}), "
        f"results as ({union})"
    )


SCORED_SQL = (
    "sc as (select *, y_pred - y_true as error, cast(month(target_start) as bigint) as month, "
    "cast(year(target_start) as bigint) as year from results where y_true is not null)"
)

# Holidays as SQL, by the same statutory rules.
HOLIDAY_SQL = (
    "hy as (select cast(unnest(generate_series(1990, 2030)) as integer) as y), "
    "he as (select y, y % 19 as a, y // 100 as b, y % 100 as c from hy), "
    "hf as (select *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 as h from he), "
    "hg as (select *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 as l from hf), "
    "hm as (select *, (a + 11*h + 22*l)//451 as m from hg), "
    "hx as (select *, h + l - 7*m + 114 as x from hm), "
    "easter as (select y, make_date(y, x//31, x%31 + 1) as e from hx), "
    "hol as (select unnest([make_date(y,1,1), e - 2, make_date(y,6,24), make_date(y,7,1), make_date(y,12,25), "
    "make_date(y,5,18) + cast((8 - isodow(make_date(y,5,18))) % 7 as integer), "
    "make_date(y,9,1) + cast((8 - isodow(make_date(y,9,1))) % 7 as integer), "
    "make_date(y,10,8) + cast((8 - isodow(make_date(y,10,8))) % 7 as integer)]) as holiday from easter)"
)


def window_holiday_sql(days: str, window: int) -> str:
    """CTEs ``wd`` (exploded window days) and ``wh(s, holidays, holiday_adjacent)`` for start days ``days``."""
    return (
        f"wd as (select s, s + cast(j as integer) as d from ({days}) q cross join (select unnest(generate_series(0, {window - 1})) as j) r), "
        "wh as (select s, count(h0.holiday) as holidays, "
        "count(*) filter (where h0.holiday is null and (h1.holiday is not null or h2.holiday is not null)) as holiday_adjacent "
        "from wd left join hol h0 on h0.holiday = d left join hol h1 on h1.holiday = d - 1 left join hol h2 on h2.holiday = d + 1 group by s)"
    )


def feature_ctes(panel: str, s: Setting) -> str:
    """CTEs ending in ``feat``: the full feature table."""
    m = min_samples
    cols = {f"lag_{k}": f"cast(lag(n, {k}) over w as double)" for k in range(7)}
    cols |= {f"mean_{d}d": roll("avg", "n", d, m(d)) for d in (7, 14, 28, 91)}
    cols["sd_28d"] = roll("stddev_samp", "n", 28, m(28))
    cols |= {f"same_wd_{k}w": same_weekday_sql(s, k) for k in (4, 13)}
    for d in (7, 28):
        num, den = roll("sum", "n_sub", d, m(d)), roll("sum", "n", d, m(d))
        cols[f"sub_share_{d}d"] = f"cast(({num}) as double) / nullif(cast(({den}) as double), 0)"
    exprs = ", ".join(f"{e} as {k}" for k, e in cols.items())
    starts = f"select distinct date + {s.gap_days} as s from panel"
    return (
        f"{panel}, {HOLIDAY_SQL}, {window_holiday_sql(starts, s.window_days)}, "
        f"lev as (select date, grp, {exprs}, {forward_sql(s)} as y from panel {SERIES_SQL}), "
        "feat as (select date + {lag} as issue_date, date as cutoff, date + {gap} as target_start, lev.* exclude (date), "
        "mean_7d / nullif(mean_28d, 0) as ratio_7_28, mean_28d / nullif(mean_91d, 0) as ratio_28_91, "
        "cast(isodow(date + {gap}) as bigint) as target_weekday, cast(month(date + {gap}) as bigint) as target_month, "
        "sin(2*pi()*dayofyear(date + {gap})/365.25) as target_doy_sin, cos(2*pi()*dayofyear(date + {gap})/365.25) as target_doy_cos, "
        "holidays, holiday_adjacent from lev join wh on wh.s = date + {gap})"
    ).format(lag=s.publication_lag_days, gap=s.gap_days)
