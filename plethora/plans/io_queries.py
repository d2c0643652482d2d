"""Queries that write and read formats, and the small operators around reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plethora.operators import metrics as me
from plethora.operators.windows import spread_row_number
from plethora.operators import order_stats as os
from plethora.operators import slices as sl
from plethora.plans.registry import EV, events, query, r6, read
from plethora.sources import files
from plethora.sources.shared import fresh_path


@query("SRC7 SRC9 SNK1", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal, 6) END AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    """Written as CSV with gaps, and read back with an explicit schema; NaN and empty fields are NULL."""
    d = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    path = fresh_path(spark, "csv")
    files.write_csv(d, path)
    return files.csv(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string").withColumn("c_acctbal", r6("c_acctbal"))


@query("SNK2 DM16", """SELECT o_orderpriority, metric, round(value, 6) AS value FROM (SELECT o_orderpriority, count(*)::DOUBLE AS n, median(o_totalprice) AS med, max(o_totalprice) AS top FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (n, med, top))""")
def json_report_round_trip(spark, sf):
    """A report as JSON documents, read back and unfolded to metric rows."""
    d = read(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    g = d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("o_totalprice").alias("top"))
    g = os.with_quantiles(g, d, ["o_orderpriority"], "o_totalprice", {"med": 0.5})
    path = fresh_path(spark, "json")
    files.write_json(g, path)
    back = spark.read.schema(g.schema).json(path)
    return files.metrics_table(back, ["o_orderpriority"]).withColumn("value", r6("value"))


@query("SNK3 SRC5 SRC6", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY 1")
def partitioned_extract(spark, sf):
    """Written as Parquet by nation, and scanned by partition."""
    path = fresh_path(spark, "parquet")
    files.write_parquet(read(spark, sf, "supplier"), path, "s_nationkey")
    return files.parquet(spark, path).groupBy(F.col("s_nationkey").cast("int").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"))


@query("SNK5", """WITH now AS (SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY 1), said AS (SELECT event_type, CASE WHEN event_type = 'click' THEN n + 1 ELSE n END AS n, mean FROM now)
SELECT now.event_type, now.n AS now_n, said.n AS said_n, now.n <> said.n OR now.mean <> said.mean AS stale FROM now JOIN said ON now.event_type = said.event_type""")
def stale_report_check(spark, sf):
    """Numbers that a document states against what the data give now; one is wrong on purpose."""
    now = events(spark, sf).groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"))
    said = now.select("activity", F.when(F.col("activity") == "click", F.col("n") + 1).otherwise(F.col("n")).alias("said_n"), F.col("mean").alias("said_mean"))
    return now.join(said, "activity").select(F.col("activity").alias("event_type"), F.col("n").alias("now_n"), "said_n", ((F.col("n") != F.col("said_n")) | (F.col("mean") != F.col("said_mean"))).alias("stale"))


@query("SNK6", "SELECT event_type, count(*) FILTER (regexp_matches(props, 'a|1')) AS hits, count(*) AS n FROM events GROUP BY 1")
def keyword_audit(spark, sf):
    """Which texts name any of the words looked for."""
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("props").rlike("a|1")).alias("hits"), F.count(F.lit(1)).alias("n"))


@query("JN10", """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) SELECT c_custkey, p_partkey FROM a JOIN b ON a.r = b.r""")
def positional_join(spark, sf):
    """Rows aligned by their number."""
    left = spread_row_number(read(spark, sf, "customer").select("c_custkey"), [], [F.asc("c_custkey")], "r")
    right = spread_row_number(read(spark, sf, "part").select("p_partkey"), [], [F.asc("p_partkey")], "r")
    return left.join(right, "r").select("c_custkey", "p_partkey")


@query("SIG21", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 10 - 0.5, 0)::DOUBLE AS away, round_even(l_quantity / 2, 0)::DOUBLE AS even FROM lineitem")
def rounding_modes(spark, sf):
    """Halves away from zero, and halves to even."""
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 10 - 0.5, 0).alias("away"), F.rint(F.col("l_quantity") / 2).alias("even"))


@query("SIG22 AGG26", f"""WITH {EV} SELECT rec, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(greatest(0, sum(value * value) / count(*) - (sum(value) / count(*)) * (sum(value) / count(*)))) END, 6) AS sd FROM ev GROUP BY rec""")
def sum_of_squares_sd(spark, sf):
    """Spread by sums in the order of the packets, as the stress baseline keeps it."""
    d = events(spark, sf).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))), lambda x: x["value"]).alias("x"))
    add = lambda s, v: F.struct((s["s"] + v).alias("s"), (s["q"] + v * v).alias("q"))
    d = d.select("rec", F.size("x").alias("n"), F.aggregate("x", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), add).alias("t"))
    mean = F.col("t.s") / F.col("n")
    return d.select("rec", F.col("n").cast("long").alias("n"), r6(F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("t.q") / F.col("n") - mean * mean))), "sd"))


@query("SET1 SET4", "SELECT kind, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY kind")
def union_of_records(spark, sf):
    both = read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k")).unionByName(read(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys"))


@query("OPT3", f"""WITH {EV}, d AS (SELECT rec, us // 3600000000 AS hour, value, i FROM ev) SELECT rec, hour, count(*) AS n, round(avg(value), 6) AS mean, round(arg_max(value, i), 6) AS last FROM d GROUP BY rec, hour""")
def history_export(spark, sf):
    """One row per recording and step of time, written as CSV and read back."""
    d = events(spark, sf).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    g = d.groupBy("rec", "hour").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"), r6(F.max_by("value", F.struct("us", "event_id")), "last"))
    path = fresh_path(spark, "history")
    files.write_csv(g, path)
    return files.csv(spark, path, "rec long, hour long, n long, mean double, last double")


@query("SRC12 DM1")
def synthetic_recordings(spark, sf):
    """The seeded cases as long rows: samples, level and swing of each."""
    from plethora.sources.synthetic import samples

    return samples(spark).groupBy("record", "fs").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ir"), "level"), r6(F.max("ir") - F.min("ir"), "swing"))


@query("SNK2 AGG19", """SELECT o_orderpriority AS ref, o_orderstatus AS shown, count(*) AS m FROM orders GROUP BY ALL""")
def confusion_counts(spark, sf):
    return me.confusion(read(spark, sf, "orders"), [], "o_orderpriority", "o_orderstatus")


@query("SNK5", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
SELECT 0 AS line, '| event_type | n | mean |' AS text UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY event_type), '| ' || event_type || ' | ' || n || ' | ' || round(m * 100, 0)::BIGINT || ' |' FROM g""")
def report_table(spark, sf):
    """A report's table as lines of a document: heading, rule, a row per event type (means in hundredths)."""
    g = events(spark, sf).groupBy(F.col("activity").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value") * 100).cast("long").alias("mean"))
    return files.document_table(spread_row_number(g, [], [F.asc("event_type")], "row"), ["event_type", "n", "mean"], "row").select(F.col("line").cast("long").alias("line"), "text")


@query("SRC8 SNK2", """SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 6) AS top FROM orders GROUP BY 1""")
def json_document_scan(spark, sf):
    """Pretty reports, one document per file and over many lines, read back with an explicit schema."""
    g = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r6(F.max("o_totalprice"), "top"))
    path = fresh_path(spark, "reports")
    files.write_documents(g, path, "o_orderstatus")
    return files.json_report(spark, f"{path}/*", "o_orderstatus string, n long, top double")


@query("SRC1 SRC2 SNK3", f"""WITH {EV} SELECT rec, i, round(round_even(value * 50, 0) / 50, 6) AS value FROM ev""")
def wfdb_round_trip(spark, sf):
    """Each user's events as a WFDB record of two signals, written and scanned again in spans: one channel of it."""
    from plethora.sources import recordings

    recordings.register(spark)
    d = sl.numbered(events(spark, sf).select("rec", "us", "event_id", "value"), ["rec"], [F.asc("us"), F.asc("event_id")])
    rows = d.select(F.col("rec").cast("string").alias("record"), "i", "value", F.lit(1.0).alias("gate")).repartition("record").sortWithinPartitions("record", "i")
    path = fresh_path(spark, "wfdb")
    rows.write.format("wfdb").mode("append").options(fs="4", gain="50", bits="32").save(path)
    back = spark.read.format("wfdb").options(signals="value", span="400").load(path)
    return back.select(F.col("record").cast("long").alias("rec"), "i", r6("value", "value"))
