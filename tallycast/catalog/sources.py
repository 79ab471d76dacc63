"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast import spec as S
from tallycast.catalog import query
from tallycast.catalog.inputs import LINE_PANEL, SCORED_SQL, ORDER_PANEL, VALIDATION, line_panel, order_panel, results_ctes, table
from tallycast.operators import metrics as M
from tallycast.plans.backtest import rolling_origin
from tallycast.sources import jsonlogs as JL
from tallycast.sources import manifest as MF
from tallycast.sources import records as RC
from tallycast.sources import sinks


_TEXT = ("tx as (select o_orderkey, case when o_orderstatus = 'P' then strftime(o_orderdate, '%Y-%m-%d') when o_totalprice > 450000 then 'n/a' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as created from orders), "
         "pt as (select *, coalesce(try_strptime(created, '%Y-%m-%dT%H:%M:%S'), try_strptime(created, '%Y-%m-%d')) as ts from tx)")


def order_text(spark, sf):
    """Orders with their date as export text: full, date-only and unreadable values."""
    full = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_totalprice") > 450000, "n/a").otherwise(full)
    return table(spark, sf, "orders").select("o_orderkey", text.alias("created"))


@query("a04_two_format_times", f"with {_TEXT} select o_orderkey, created like '%T%' as has_time, ts as created, cast(ts as date) as date, cast(year(ts) as bigint) as year from pt where ts is not null")
def a04(spark, sf):
    return RC.require_times(order_text(spark, sf).where("created <> 'n/a'"), "created").select("o_orderkey", "has_time", "created", "date", "year")


@query("a04_unreadable_times", f"with {_TEXT} select o_orderkey, created, ts is null as unreadable from pt")
def a04_bad(spark, sf):
    """Every export row and whether its time can be read; nothing is dropped before the test."""
    text = order_text(spark, sf).withColumn("raw", F.col("created"))
    return RC.with_event_time(text, "created").select("o_orderkey", F.col("raw").alias("created"), F.col("created").isNull().alias("unreadable"))


@query("a05_parse_quality", f"with {_TEXT} select count(*) as rows, count(*) filter (where ts is null) as invalid, count(*) filter (where ts is not null and created not like '%T%') as date_only from pt")
def a05(spark, sf):
    return RC.bad_times(order_text(spark, sf), "created")


@query("a01_typed_csv_scan", "select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, true as has_file from orders")
def a01(spark, sf):
    """Orders written as CSV exports and scanned back with an explicit schema."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
                                          "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    path = sinks.write_report(o, sinks.scratch_path(spark, "csv-export"))
    schema = RC.event_schema(["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderdate"], ["o_totalprice"], o.columns)
    return RC.read_events(spark, path, schema).withColumn("has_file", F.col("source_file").endswith(".csv")).drop("source_file")


@query("a06_partitioned_parquet", f"with {ORDER_PANEL} select date, grp, n, n_sub, cast(year(date) as integer) as year from panel where year(date) = 1997")
def a06(spark, sf):
    """Panel written by year and read back with partition pruning."""
    p = order_panel(spark, sf).withColumn("year", F.year("date"))
    return sinks.stage(p, "panel", ["year"]).where("year = 1997")


_RES = f"{results_ctes(LINE_PANEL, S.DAILY, *VALIDATION, (13,))}, {SCORED_SQL}"


@query("a07_csv_report", f"with {_RES} select model, count(*) as n, avg(abs(error)) as mae from sc group by model")
def a07(spark, sf):
    r = M.scored(rolling_origin(line_panel(spark, sf), S.DAILY, *VALIDATION, (13,))).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"))
    path = sinks.write_report(r, sinks.scratch_path(spark, "report"))
    return spark.read.schema("model string, n bigint, mae double").option("header", True).csv(path)


@query("a08_fingerprints")
def a08(spark, sf):
    return MF.fingerprint(spark, sf, "*.parquet")


@query("a08_written_files", "select 'key=' || n_nationkey as folder, sha256(n_name || chr(10) || n_regionkey || chr(10)) as sha256, cast(strlen(n_name || n_regionkey) + 2 as bigint) as bytes from nation")
def a08w(spark, sf):
    """Fingerprints of files written from the nations, a folder of its own each."""
    n = table(spark, sf, "nation")
    lines = n.select(F.col("n_nationkey").alias("key"), F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    folder = sinks.scratch_path(spark, "nations")
    lines.repartition("key").write.partitionBy("key").text(folder)
    got = MF.fingerprint(spark, folder)
    return got.select(F.substring_index("path", "/", 1).alias("folder"), "sha256", "bytes")


_EXPECT = "ex as (select p_name || '-' || p_partkey as path, sha256(p_brand) as sha256, cast(p_size as bigint) as bytes from part), ac as (select p_name || '-' || p_partkey as path, sha256(case when p_size % 7 = 3 then 'x' else p_brand end) as sha256, cast(case when p_size % 5 = 2 then p_size + 1 else p_size end as bigint) as bytes from part where p_type <> 'PROMO')"


def _manifests(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("path")
    size, brand = F.col("p_size").cast("bigint"), F.col("p_brand")
    expected = p.select(path, F.sha2(brand, 256).alias("sha256"), size.alias("bytes"))
    actual = p.where("p_type <> 'PROMO'").select(
        path, F.sha2(F.when(F.col("p_size") % 7 == 3, F.lit("x")).otherwise(brand), 256).alias("sha256"),
        F.when(F.col("p_size") % 5 == 2, size + 1).otherwise(size).alias("bytes"))
    return expected, actual


@query("a09_manifest_diff", f"with {_EXPECT}, d as (select ex.path, case when ac.bytes is null then 'missing' when ac.bytes <> ex.bytes then 'size changed' when ac.sha256 <> ex.sha256 then 'content changed' end as problem from ex left join ac on ac.path = ex.path) select * from d where problem is not null")
def a09(spark, sf):
    """Manifests whose entries are the parts table, one with changed and missing rows."""
    return MF.diff(*_manifests(spark, sf))


@query("a10_source_profile", "with f as (select source as path, sha256(source) as sha256, cast(sum(strlen(text)) as bigint) as bytes from documents group by source) "
       "select d.source, count(*) as rows, min(doc_id) as first, max(doc_id) as last, max(bytes) as bytes, max(substr(sha256, 1, 12)) as sha256_12 from documents d join f on f.path = d.source group by d.source")
def a10(spark, sf):
    d = table(spark, sf, "documents")
    f = d.groupBy(F.col("source").alias("path")).agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes")).withColumn("sha256", F.sha2("path", 256))
    return MF.source_profile(d, "source", "doc_id", f)


@query("a11_upload_history", "with e as (select 'r' || (user_id % 5) as id, strftime(ts, '%Y-%m-%dT%H') as last_modified, event_id as size from events) select last_modified, max(size) as size from e where id = 'r1' group by 1")
def a11(spark, sf):
    """Activity logs built from the events, one document per user and day."""
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"), F.struct(
        F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("last_modified"), F.col("event_id").alias("size")).alias("r"))
    docs = ev.groupBy("user_id", "d").agg(F.collect_list("r").alias("resources")).select(F.to_json(F.struct(F.array(F.struct(
        F.struct(F.struct("resources").alias("package")).alias("data"))).alias("result"))).alias("value"))
    return JL.upload_history(docs, "r1")


_PKG = "r as (select cast(s_nationkey as varchar) as id, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos, s_name as name, cast(s_acctbal as bigint) as size from supplier)"


def package_docs(spark, sf):
    s = table(spark, sf, "supplier")
    res = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))),
                      lambda x: F.struct(x["s_name"].alias("name"), F.lit("CSV").alias("format"), F.round(x["s_acctbal"] - 0.5).cast("bigint").alias("size")))
    return s.groupBy(F.col("s_nationkey").cast("string").alias("id")).agg(res.alias("resources")).select(F.to_json(F.struct("id", "resources")).alias("value"))


@query("a13_package_resources", f"with {_PKG} select id, pos, name from r")
def a13(spark, sf):
    return JL.package_resources(package_docs(spark, sf)).select("id", "pos", "name")


@query("a13_first_with_prefix", f"with {_PKG} select id, min(pos) as pos, arg_min(name, pos) as name from r where name like 'Supplier#00000001%' group by id")
def a13p(spark, sf):
    return JL.first_with_prefix(JL.package_resources(package_docs(spark, sf)), "Supplier#00000001")


_REP = " union all ".join(
    f"(with {results_ctes(LINE_PANEL, s, *VALIDATION)}, {SCORED_SQL} select '{lab}' as label, model, count(*) as n, avg(abs(error)) as mae, avg(error) as bias, sum(abs(error)) / nullif(sum(y_true), 0) as wape from sc group by model)"
    for lab, s in (("v2", S.DAILY), ("lead3", S.Setting(lead_days=3))))
_FINAL, _REFS = "same_wd_26w", ("same_wd_13w", "plain_28d")
_A14 = (f"t as ({_REP}), p as (select label, count(distinct n) = 1 as equal_n, min(mae) filter (where model = '{_FINAL}') as final_mae, arg_min(model, {{'m': mae, 'n': model}}) filter (where model <> '{_FINAL}') as best from t group by label), "
        f"j as (select t.label, model, case when model = '{_FINAL}' then 'final' when model = best then 'best_single' when model in {_REFS} then 'reference' end as role, n, mae, bias, wape, final_mae - mae as final_minus, equal_n as consistent from t join p on p.label = t.label)")


@query("a14_report_comparison", f"with {_A14} select * from j where role is not null")
def a14(spark, sf):
    """Score tables stored as report JSON, one document per setting, and compared again."""
    docs = None
    for lab, setting in (("v2", S.DAILY), ("lead3", S.Setting(lead_days=3))):
        sc = M.scored(rolling_origin(line_panel(spark, sf), setting, *VALIDATION)).groupBy("model").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"), (F.sum(F.abs("error")) / F.sum("y_true")).alias("wape"))
        # A report has one entry per model.
        doc = sc.agg(F.to_json(F.struct(
            F.lit(lab).alias("label"), F.struct(F.lit(VALIDATION[0]).alias("start"), F.lit(VALIDATION[1]).alias("end")).alias("period"),
            F.collect_list(F.struct("model", "n", "mae", "bias")).alias("overall"),
            F.map_from_entries(F.collect_list(F.struct("model", "wape"))).alias("wape"))).alias("value"))
        docs = doc if docs is None else docs.unionByName(doc)
    return JL.setting_comparison(JL.report_rows(docs), _FINAL, list(_REFS))


@query("b16_horizon_labels", "with l as (select distinct case when l_linenumber = 7 then 'weekly' when l_linenumber = 6 then 'v2' when l_linenumber = 5 then 'bad' else 'lead' || (l_linenumber * 7 - 6) end as label from lineitem), q as (select label, nullif(regexp_extract(label, '^lead([1-9][0-9]*)$', 1), '') as lead from l) "
       "select label, case when label not in ('weekly', 'v2') and lead is null then null when lead = '1' then 'v2' else label end as canonical, case when label in ('weekly', 'v2') or lead is not null then cast(2 as bigint) end as publication_lag_days, "
       "case when lead is not null then cast(lead as bigint) when label in ('weekly', 'v2') then 1 end as lead_days, case when label = 'weekly' then 7 when label = 'v2' or lead is not null then cast(1 as bigint) end as window_days from q")
def b16(spark, sf):
    n = F.col("l_linenumber")
    label = F.when(n == 7, "weekly").when(n == 6, "v2").when(n == 5, "bad").otherwise(F.concat(F.lit("lead"), (n * 7 - 6).cast("string")))
    t = table(spark, sf, "lineitem").select(label.alias("label")).distinct()
    return t.select("label", *(c.alias(k) for k, c in S.label_columns(F.col("label")).items()))
