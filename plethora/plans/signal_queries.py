"""Queries over the event stream as beats, samples and ticks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plethora.operators import cleaning as cl
from plethora.operators import intervals as iv
from plethora.operators import windows as wi
from plethora.operators import slices as sl
from plethora.plans.registry import EV, events, query, r6, read

DAY_US = 86_400_000_000


#: Rows of a slice of a user's events, so that their few hundred make several.
_SLICE = 64


@query("SIG9 WIN4", f"""WITH {EV}, d AS (SELECT rec, value - lag(value) OVER (PARTITION BY rec ORDER BY i) AS diff FROM ev)
SELECT rec, count(*) AS n, round(coalesce(sqrt(avg(diff * diff)), 0), 6) AS rmssd FROM d GROUP BY rec""")
def rmssd_by_user(spark, sf):
    d = iv.with_difference(events(spark, sf), "value", wi.ordered("rec", "us", "event_id"))
    return d.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), r6(iv.rmssd("diff"), "rmssd"))


@query("SIG9 WIN1 WIN4 AGG23", f"""WITH {EV}, d AS (SELECT rec, us // {DAY_US} AS day, value, value - lag(value) OVER (PARTITION BY rec, us // {DAY_US} ORDER BY i) AS diff FROM ev)
SELECT rec, day, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(coalesce(sqrt(avg(diff * diff)), 0), 6) END AS rmssd FROM d GROUP BY rec, day""")
def rmssd_by_user_day(spark, sf):
    d = events(spark, sf).withColumn("day", F.floor(F.col("us") / DAY_US))
    return iv.window_rmssd(d, ["rec", "day"], ["us", "event_id"], "value", 3).select("rec", "day", "n", r6("rmssd", "rmssd"))


@query("AGG21", f"""WITH {EV}, o AS (SELECT rec, i, value * 20 AS v, value * 20 BETWEEN 300 AND 2000 AS ok FROM ev),
d AS (SELECT rec, ok, CASE WHEN ok AND lag(ok) OVER w THEN v - lag(v) OVER w END AS pair FROM o WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT rec, count(*) FILTER (ok) AS n_valid, CASE WHEN count(*) FILTER (ok) >= 20 THEN round(sqrt(avg(pair * pair)), 6) END AS rmssd FROM d GROUP BY rec""")
def ref_rmssd_valid_pairs(spark, sf):
    d = events(spark, sf).withColumn("v", F.col("value") * 20)
    return iv.reference_rmssd(d, ["rec"], ["us", "event_id"], "v").select("rec", "n_valid", r6("rmssd", "rmssd"))


_PAD = f"""{EV}, p AS (SELECT rec, i, value * 20 + 300 AS v FROM ev), e AS (SELECT rec, max(i) AS hi FROM p GROUP BY rec),
m AS (SELECT p.rec, p.i, any_value(p.v) AS v, quantile_disc(q.v, 0.5) AS med FROM p JOIN e ON p.rec = e.rec, range(-5, 6) AS k(k), p q
  WHERE q.rec = p.rec AND q.i = greatest(0, least(e.hi, p.i + k.k)) GROUP BY p.rec, p.i)"""


@query("SIG20", f"WITH {_PAD} SELECT rec, i, round(med, 6) AS med FROM m")
def median11_filter(spark, sf):
    """In slices of a recording that carry five rows of either neighbour."""
    d, w = sl.haloed(events(spark, sf).withColumn("v", F.col("value") * 20 + 300), ["rec"], [F.asc("us"), F.asc("event_id")], 5, 5, _SLICE)
    return sl.own_rows(d.withColumn("med", iv.centred_median("v", w))).select("rec", F.col("i").cast("long").alias("i"), r6("med", "med"))


@query("AGG22 SIG20", f"""WITH {_PAD}, o AS (SELECT *, v BETWEEN 300 AND 2000 AND abs(v - med) <= 0.2 * med AS ok FROM m),
d AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w THEN v - lag(v) OVER w END AS pair FROM o WINDOW w AS (PARTITION BY rec ORDER BY i)),
g AS (SELECT rec, count(*) AS n, count(*) FILTER (ok) AS n_valid, avg(ok::INT) AS share, count(pair) AS np, sqrt(avg(pair * pair)) AS rm, median(v) FILTER (ok) AS mv FROM d GROUP BY rec)
SELECT rec, n, n_valid, CASE WHEN n >= 20 THEN round(1 - share, 6) END AS reject_frac, CASE WHEN n >= 20 AND n_valid >= 20 AND np >= 19 THEN round(rm, 6) END AS rmssd,
  CASE WHEN n >= 20 AND n_valid >= 20 AND np >= 19 THEN round(60000 / mv, 6) END AS hr FROM g""")
def median11_cleaning(spark, sf):
    d = events(spark, sf).withColumn("v", F.col("value") * 20 + 300)
    return iv.clean_rmssd(d, ["rec"], ["us", "event_id"], "v").select("rec", "n", "n_valid", *[r6(c, c) for c in ("reject_frac", "rmssd", "hr")])


@query("AGG25 PRJ12 F9-F14", f"""WITH {EV}, v AS (SELECT rec, i, activity, value + 400 AS v FROM ev),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY rec ORDER BY i) AS diff FROM v),
g AS (SELECT rec, count(*) AS n, median(v) AS med, stddev_pop(v) / avg(v) AS cv, median(abs(diff)) AS mad, max(abs(diff)) AS mx, sqrt(avg(diff * diff)) AS rm,
  count(*) FILTER (activity <> 'error') AS peaks FROM d GROUP BY rec)
SELECT rec, n, CASE WHEN n >= 3 THEN round(60000 / med, 6) END AS hr, CASE WHEN n >= 3 THEN round(greatest(-1, least(1, 1 - peaks / (60000 / med))), 6) END AS miss_frac_est,
  CASE WHEN n >= 3 THEN round(cv, 6) END AS rr_cv, CASE WHEN n >= 3 THEN round(mad / med, 6) END AS rr_diff_mad_rel, CASE WHEN n >= 3 THEN round(mx / med, 6) END AS rr_diff_max_rel,
  CASE WHEN n >= 3 THEN round(coalesce(rm, 0), 6) END AS rmssd FROM g""")
def interval_features(spark, sf):
    d = events(spark, sf).withColumn("v", F.col("value") + 400)
    f = iv.interval_features(d, ["rec"], ["us", "event_id"], "v", F.count_if(F.col("activity") != "error"))
    return f.select("rec", "n", *[r6(c, c) for c in f.columns if c not in ("rec", "n")])


@query("PRJ12", """SELECT user_id AS rec, count(*) AS n_peaks, count(*) FILTER (event_type = 'view') AS n_accepted,
round(CASE WHEN count(*) > 0 THEN greatest(0, least(1, 1 - count(*) FILTER (event_type = 'view') / greatest(count(*), 1))) ELSE 1 END, 6) AS reject_frac FROM events GROUP BY user_id""")
def rejection_proxy(spark, sf):
    g = events(spark, sf).groupBy("rec").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_if(F.col("activity") == "view").alias("n_accepted"))
    return g.withColumn("reject_frac", r6(cl.rejection_proxy("n_peaks", "n_accepted")))


@query("PRJ9 JN6 AGG1 F1-F5", f"""WITH {EV}, t AS (SELECT rec, (us - min(us) OVER (PARTITION BY rec)) / 3600000000.0::DOUBLE AS h, value / 100 AS per, activity FROM ev),
q AS (SELECT rec, CASE WHEN h > 10 THEN ceil((h - 10) / 60) - 1 END AS win, CASE WHEN activity IN ('click', 'view') THEN 0 ELSE per * 0.5 END AS amp, CASE WHEN activity = 'click' THEN 0 ELSE per END AS p FROM t)
SELECT rec, win::BIGINT AS win, round(median(amp), 6) AS sqi_amp, round(median(p), 6) AS sqi_per, round(avg((p < 0.5)::INT), 6) AS penalty_frac FROM q WHERE win IS NOT NULL GROUP BY rec, win""")
def tick_window_sqi_median(spark, sf):
    """Clicks play early rejects, views weak modulation; hours play seconds."""
    w = Window.partitionBy("rec")
    reject = F.when(F.col("activity") == "click", "flat").when(F.col("activity") == "view", "zombie").otherwise("")
    d = events(spark, sf).select("rec", ((F.col("us") - F.min("us").over(w)) / 3.6e9).alias("h"), (F.col("value") / 100).alias("per"), reject.alias("reject"), F.lit(0.5).alias("penalty"))
    amp, per = cl.sqi_components("reject", "per", "penalty", "per")
    q = d.select("rec", wi.tumbling_right(F.col("h")).alias("win"), amp.alias("amp"), per.alias("p")).where("win IS NOT NULL")
    return q.groupBy("rec", "win").agg(r6(F.median("amp"), "sqi_amp"), r6(F.median("p"), "sqi_per"), r6(F.avg((F.col("p") < 0.5).cast("double")), "penalty_frac"))


@query("SIG10 SIG11 WIN2", f"""WITH {EV}, d AS (SELECT rec, i, value, count(*) OVER w AS n, avg(value) OVER w AS dc, max(value) OVER w - min(value) OVER w AS pp, avg(value) OVER v AS m, stddev_pop(value) OVER v AS sd, count(*) OVER v AS nv
  FROM ev WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), v AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN n < 5 THEN 'warmup' WHEN dc < 10 THEN 'presence' WHEN pp < 0.001 THEN 'flat' ELSE '' END AS early, pp / dc AS mod, CASE WHEN nv >= 3 AND m > 0 THEN greatest(0, least(1, 1 - 0.5 * sd / m)) ELSE 0 END AS per FROM d),
z AS (SELECT *, least(1, mod / 4) AS score, CASE WHEN mod > 3 THEN 0 WHEN mod > 2 THEN 0.5 ELSE 1 END::DOUBLE AS penalty FROM s)
SELECT rec, i, CASE WHEN early <> '' THEN early WHEN score < 0.1 THEN 'zombie' ELSE '' END AS reject, round(CASE WHEN early <> '' OR score < 0.1 THEN 0 ELSE least(1, (0.4 * score + 0.6 * per) * penalty) END, 6) AS sqi FROM z""")
def rolling_sqi_parts(spark, sf):
    """The ungated quality index over frames of rows, in slices of a recording that carry the rows before them; thresholds scaled to the events' values."""
    d, within = sl.haloed(events(spark, sf), ["rec"], [F.asc("us"), F.asc("event_id")], 60, 0, _SLICE)
    w, v = within.rowsBetween(-9, 0), within.rowsBetween(-59, 0)
    mean, swing = F.avg("value").over(w), F.max("value").over(w) - F.min("value").over(w)
    early = F.when(F.count("value").over(w) < 5, "warmup").when(mean < 10, "presence").when(swing < 0.001, "flat").otherwise("")
    d = sl.own_rows(d.select("rec", "_slice", "_own", F.col("i").cast("long").alias("i"), early.alias("early"), cl.ratio(swing, mean).alias("mod"), iv.periodicity("value", v).alias("per")))
    d = d.withColumns({"score": F.least(F.lit(1.0), F.col("mod") / 4), "penalty": F.when(F.col("mod") > 3, 0.0).when(F.col("mod") > 2, 0.5).otherwise(1.0)})
    reject = F.when(F.col("early") != "", F.col("early")).when(F.col("score") < 0.1, "zombie").otherwise("")
    return d.withColumn("reject", reject).select("rec", "i", "reject", r6(F.when(F.col("reject") != "", 0.0).otherwise(F.least(F.lit(1.0), (0.4 * F.col("score") + 0.6 * F.col("per")) * F.col("penalty"))), "sqi"))


@query("SIG5 WIN2", f"""WITH {EV}, d AS (SELECT rec, i, lag(value) OVER o AS p, lag(value, 2) OVER o AS pp, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n
  FROM ev WINDOW o AS (PARTITION BY rec ORDER BY i), w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT rec, i - 1 AS peak_i, round(p, 6) AS height FROM d WHERE p > pp AND p > value AND n >= 10 AND p > m + 0.4 * sd""")
def local_peaks_adaptive(spark, sf):
    """Candidates of the adaptive detector: the row before is a local maximum above mean and spread of the frame."""
    o, w = Window.partitionBy("rec").orderBy("i"), wi.last_n("rec", 20, "i")
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id")
    d = d.select("rec", "i", "value", F.lag("value").over(o).alias("p"), F.lag("value", 2).over(o).alias("pp"), F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("sd"), F.count("value").over(w).alias("n"))
    return d.where("p > pp AND p > value AND n >= 10 AND p > m + 0.4 * sd").select("rec", (F.col("i") - 1).cast("long").alias("peak_i"), r6("p", "height"))


@query("WIN3 SIG8", f"""WITH {EV}, d AS (SELECT rec, i, count(*) OVER w AS n, median(value + 400) OVER w AS med FROM ev WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT rec, i, CASE WHEN n >= 3 THEN round(60000 / med, 6) END AS hr FROM d""")
def last10_hr(spark, sf):
    d = wi.packet_index(events(spark, sf).withColumn("v", F.col("value") + 400), "rec", "us", "event_id")
    return d.select("rec", F.col("i").cast("long").alias("i"), r6(iv.rate_of_last("v", wi.last_n("rec", 10, "i")), "hr"))


@query("WIN3 SIG9", f"""WITH {EV}, d AS (SELECT rec, i, value - lag(value) OVER (PARTITION BY rec ORDER BY i) AS diff FROM ev)
SELECT rec, i, round(coalesce(sqrt(avg(diff * diff) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)), 0), 6) AS rmssd FROM d""")
def last60_rmssd(spark, sf):
    """Sixty intervals have fifty-nine differences."""
    d = iv.with_difference(wi.packet_index(events(spark, sf), "rec", "us", "event_id"), "value", Window.partitionBy("rec").orderBy("i"))
    square = F.avg(F.col("diff") * F.col("diff")).over(wi.last_n("rec", 59, "i"))
    return d.select("rec", F.col("i").cast("long").alias("i"), r6(F.coalesce(F.sqrt(square), F.lit(0.0)), "rmssd"))


@query("SIG1 WIN2", f"""WITH {EV}, d AS (SELECT rec, i, avg(value) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM ev) SELECT rec, i, round(s, 6) AS smoothed FROM d WHERE i > 0""")
def moving_average2(spark, sf):
    """The first packet gives nothing."""
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id")
    return d.select("rec", F.col("i").cast("long").alias("i"), r6(F.avg("value").over(wi.last_n("rec", 2, "i")), "smoothed")).where("i > 0")


@query("WIN6 SET3", f"""WITH {EV}, t AS (SELECT rec, activity, (us - min(us) OVER (PARTITION BY rec)) / 60000000.0::DOUBLE AS m FROM ev)
SELECT rec, floor((m - 10) / 1800)::BIGINT AS session, count(*) AS n, count(DISTINCT activity) AS kinds FROM t WHERE m >= 10 GROUP BY ALL""")
def sessionize_1800(spark, sf):
    """Fixed sessions, minutes playing seconds."""
    d = events(spark, sf).withColumn("m", (F.col("us") - F.min("us").over(Window.partitionBy("rec"))) / 6e7).where("m >= 10")
    return d.groupBy("rec", wi.session_number(F.col("m")).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("activity").alias("kinds"))


@query("WIN7", f"""WITH {EV}, t AS (SELECT *, us // {DAY_US} AS day FROM ev) SELECT rec, day, arg_max(event_id, i) AS event_id, round(arg_max(value, i), 6) AS value FROM t GROUP BY rec, day""")
def sample_at_window_end(spark, sf):
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id").withColumn("day", F.floor(F.col("us") / DAY_US))
    return wi.at_window_end(d, ["rec", "day"], "i", "event_id", "value").withColumn("value", r6("value"))


@query("WIN5", f"""WITH {EV} SELECT rec, i, coalesce(lag(value >= 50) OVER (PARTITION BY rec ORDER BY i), FALSE) AS open FROM ev""")
def shifted_gate(spark, sf):
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id")
    return d.select("rec", F.col("i").cast("long").alias("i"), wi.shifted_gate(F.col("value"), 50, Window.partitionBy("rec").orderBy("i")).alias("open"))


@query("WIN1 JN6", f"""WITH {EV}, t AS (SELECT rec, value, (us - min(us) OVER (PARTITION BY rec)) / 3600000000.0::DOUBLE AS h, (max(us) OVER (PARTITION BY rec) - min(us) OVER (PARTITION BY rec)) / 3600000000.0::DOUBLE AS dur FROM ev),
w AS (SELECT rec, floor((h - 10) / 60)::BIGINT AS win, value, dur FROM t WHERE h >= 10)
SELECT rec, win, count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE 10 + (win + 1) * 60 <= dur + 1e-9 GROUP BY rec, win""")
def tumbling_complete(spark, sf):
    w = Window.partitionBy("rec")
    d = events(spark, sf).select("rec", "value", ((F.col("us") - F.min("us").over(w)) / 3.6e9).alias("h"), ((F.max("us").over(w) - F.min("us").over(w)) / 3.6e9).alias("dur"))
    d = d.withColumn("win", wi.tumbling(F.col("h"))).where(F.col("win").isNotNull() & wi.complete(F.col("win"), F.col("dur")))
    return d.groupBy("rec", "win").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("PRJ1 PRJ2", f"""WITH {EV}, b AS (SELECT rec, i, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM ev),
k AS (SELECT rec, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY rec ORDER BY i) AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, count(*) FILTER (v IS NULL) OVER (PARTITION BY rec) AS missing FROM b)
SELECT k.rec, k.i, round(coalesce(k.v, CASE WHEN i0 IS NULL THEN y1.v WHEN i1 IS NULL THEN y0.v ELSE y0.v + (y1.v - y0.v) * ((k.i - i0) / (i1 - i0)::DOUBLE) END, 0), 6) AS value, missing
FROM k LEFT JOIN b y0 ON y0.rec = k.rec AND y0.i = k.i0 LEFT JOIN b y1 ON y1.rec = k.rec AND y1.i = k.i1""")
def gap_interpolation(spark, sf):
    """Every fifth event is blanked first."""
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id").select("rec", F.col("i").cast("long").alias("i"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    d = d.withColumn("missing", cl.count_missing("v").over(Window.partitionBy("rec")))
    return cl.interpolate_gaps(d, "rec", "i", "v", "filled").select("rec", "i", r6("filled", "value"), "missing")


@query("PRJ3 PRJ4", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) * (16384 / 262144.0), 6) AS acc FROM lineitem""")
def vector_magnitude(spark, sf):
    d = read(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", r6(cl.magnitude("l_quantity", "l_discount", "l_tax") * (16384 / 262144), "acc"))


@query("PRJ5 AGG1", """SELECT event_id, round(2 * median(value) OVER (PARTITION BY user_id) - value, 6) AS inverted FROM events""")
def polarity_invert(spark, sf):
    return events(spark, sf).select("event_id", r6(cl.invert_polarity("value", "rec"), "inverted"))


@query("PRJ6 PRJ15 WIN8", f"""WITH {EV}, k AS (SELECT 's' || rec || '_' || activity AS record, us FROM ev),
p AS (SELECT regexp_extract(record, '^s(\\d+)_', 1)::INT AS subject, string_split(record, '_')[-1] AS activity, us FROM k)
SELECT subject, activity, subject || '_' || (us // 600000000) AS block, count(*) AS n FROM p GROUP BY ALL""")
def record_key_blocks(spark, sf):
    d = events(spark, sf).select(F.concat(F.lit("s"), F.col("rec").cast("string"), F.lit("_"), "activity").alias("record"), (F.col("us") / 1e6).alias("t0"))
    subject, activity = cl.parse_record("record")
    d = d.select(subject.alias("subject"), activity.alias("activity"), "t0")
    return d.groupBy("subject", "activity", cl.block_key("subject", "t0").alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ7 PRJ8 PRJ14", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS est, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 500000 END AS q, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 100 / 500.0 END AS rej FROM orders)
SELECT count(*) AS n, count(*) FILTER (coalesce(rej <= 0.1, FALSE)) AS ref_ok, count(*) FILTER (est IS NOT NULL) AS kept_all, count(*) FILTER (est IS NOT NULL AND coalesce(q >= 0.4, FALSE)) AS kept_04, count(*) FILTER (coalesce(q >= 0.4, FALSE)) AS gated FROM s""")
def gate_predicates(spark, sf):
    o = F.col("o_orderkey")
    d = read(spark, sf, "orders").select("o_orderkey", F.when(o % 7 != 0, F.col("o_totalprice")).alias("est"), F.when(o % 5 != 0, F.col("o_totalprice") / 500000).alias("q"), F.when(o % 11 != 0, o % 100 / 500.0).alias("rej"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(cl.reference_valid("o_orderkey", "rej")).alias("ref_ok"), F.count_if(cl.kept("est", "q", 0.0)).alias("kept_all"), F.count_if(cl.kept("est", "q", 0.4)).alias("kept_04"), F.count_if(cl.gate("q", 0.4)).alias("gated"))


@query("PRJ13", """WITH s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS score FROM customer)
SELECT c_custkey, round(coalesce(score, min(score) OVER (PARTITION BY c_nationkey) - 1, -1), 6) AS score FROM s""")
def worst_fill(spark, sf):
    d = read(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("score"))
    return d.select("c_custkey", r6(cl.fill_worst("score", "c_nationkey"), "score"))


@query("PRJ16 SET2", """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def alignment_check(spark, sf):
    left = cl.assert_unique(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
    right = cl.assert_unique(read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), "k")
    return cl.unmatched(left, right, "k")


@query("WIN9", f"""WITH {EV}, b AS (SELECT rec, i, i // 10 AS block, abs(value) AS v FROM ev), p AS (SELECT rec, block, quantile_cont(v, 0.98) AS p98 FROM b GROUP BY rec, block)
SELECT b.rec, b.i, round(greatest(p98, 0.1 * m), 6) AS level FROM b JOIN p ON b.rec = p.rec AND b.block = p.block JOIN (SELECT rec, median(p98) AS m FROM p GROUP BY rec) g ON b.rec = g.rec""")
def block_percentile_level(spark, sf):
    """A local level per block of rows, floored by the recording's typical one, given back to each row."""
    d = wi.packet_index(events(spark, sf), "rec", "us", "event_id").withColumn("block", F.floor(F.col("i") / 10))
    p = d.groupBy("rec", "block").agg(F.percentile(F.abs("value"), 0.98).alias("p98"))
    p = p.withColumn("level", F.greatest(F.col("p98"), 0.1 * F.median("p98").over(Window.partitionBy("rec"))))
    return d.join(p, ["rec", "block"]).select("rec", F.col("i").cast("long").alias("i"), r6("level", "level"))
