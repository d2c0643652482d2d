"""Queries of joins, metrics, ranking and resampling over orders, line items, customers, labels and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plethora.operators import cleaning as cl
from plethora.operators import evaluation as el
from plethora.operators import gates as ga
from plethora.operators import joins as jo
from plethora.operators import metrics as me
from plethora.operators import order_stats as os
from plethora.operators import ranking as ra
from plethora.operators import replicates as rp
from plethora.operators import resampling as rs
from plethora.operators.asof import asof
from plethora.operators.matching import match_summary, nearest_match
from plethora.plans.registry import EV, events, query, r6, read
from plethora.sources.shared import stage


@query("JN3 EVL7", f"""WITH {EV}, p AS (SELECT rec, us FROM ev WHERE activity = 'purchase'), c AS (SELECT rec, event_id, us FROM ev WHERE activity = 'click')
SELECT c.rec, c.event_id, round((c.us - p.us) / 1000.0, 6) AS lag_ms FROM c ASOF LEFT JOIN p ON c.rec = p.rec AND c.us > p.us""")
def asof_prev_event_lag(spark, sf):
    ev = events(spark, sf)
    d = asof(ev.where("activity = 'click'").select("rec", "event_id", "us"), ev.where("activity = 'purchase'").select("rec", "us"), "rec", "us")
    return d.select("rec", "event_id", r6((F.col("us") - F.col("prev")) / 1000.0, "lag_ms"))


@query("JN4", f"""WITH {EV}, p AS (SELECT rec, us, value FROM ev WHERE activity = 'purchase'), c AS (SELECT rec, event_id, us FROM ev)
SELECT c.rec, c.event_id, round(p.value, 6) AS value FROM c ASOF LEFT JOIN p ON c.rec = p.rec AND c.us >= p.us""")
def asof_inclusive_value(spark, sf):
    ev = events(spark, sf)
    d = asof(ev.select("rec", "event_id", "us"), ev.where("activity = 'purchase'").select("rec", "us", "value"), "rec", "us", inclusive=True, take="value", out="found")
    return d.select("rec", "event_id", r6("found", "value"))


@query("JN4 WIN3 EVL10", f"""WITH {EV}, t AS (SELECT DISTINCT rec, (us // 86400000000 + 1) * 86400000000 AS tick FROM ev),
b AS (SELECT t.rec, t.tick, ev.value + 400 AS v, row_number() OVER (PARTITION BY t.rec, t.tick ORDER BY ev.i DESC) AS back FROM t JOIN ev ON ev.rec = t.rec AND ev.us <= t.tick)
SELECT rec, tick, count(*) AS n, round(60000 / median(v) FILTER (back <= 10), 6) AS hr FROM b WHERE back <= 60 GROUP BY rec, tick""")
def tick_stream_from_beats(spark, sf):
    """Daily ticks that see the last sixty beats up to them; a beat's rolling values are made once and looked up as of the tick."""
    from plethora.operators.intervals import rate_of_last
    from plethora.operators.windows import last_n

    ev = events(spark, sf).withColumn("v", F.col("value") + 400)
    beats = ev.select("rec", "us", F.struct(F.count("v").over(last_n("rec", 60, "us", "event_id")).alias("n"), F.coalesce(rate_of_last("v", last_n("rec", 10, "us", "event_id"), 1)).alias("hr")).alias("state"))
    day = 86_400_000_000
    ticks = ev.select("rec", ((F.floor(F.col("us") / day) + 1) * day).alias("us")).distinct()
    return asof(ticks, beats, "rec", "us", inclusive=True, take="state", out="s").select("rec", F.col("us").alias("tick"), F.col("s.n").alias("n"), r6("s.hr", "hr"))


@query("JN3 AGG16 EVL7", f"""WITH {EV}, p AS (SELECT rec, us FROM ev WHERE activity = 'purchase'), c AS (SELECT rec, event_id, us FROM ev WHERE activity = 'click'),
m AS (SELECT c.rec, p.us AS r, count(*) AS k, quantile_cont((c.us - p.us) / 1000.0, 0.5) AS lag FROM c ASOF JOIN p ON c.rec = p.rec AND c.us > p.us GROUP BY c.rec, p.us),
h AS (SELECT p.rec, coalesce(m.k, 0) AS k FROM p LEFT JOIN m ON p.rec = m.rec AND p.us = m.r)
SELECT rec, count(*) AS n_r, round(100 * avg((k = 0)::INT), 6) AS missed_pct, round(100 * avg((k >= 2)::INT), 6) AS multi_pct FROM h GROUP BY rec""")
def fiducial_missed_multi(spark, sf):
    """Purchases play R peaks, clicks pulses: per recording the share of beats without and with several pulses."""
    ev = events(spark, sf)
    r = ev.where("activity = 'purchase'").select("rec", "us")
    hits = asof(ev.where("activity = 'click'").select("rec", "event_id", "us"), r, "rec", "us").where("prev IS NOT NULL").groupBy("rec", F.col("prev").alias("us")).agg(F.count(F.lit(1)).alias("k"))
    d = r.join(hits, ["rec", "us"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return d.groupBy("rec").agg(F.count(F.lit(1)).alias("n_r"), share(F.col("k") == 0).alias("missed_pct"), share(F.col("k") >= 2).alias("multi_pct"))


@query("JN5", f"""WITH RECURSIVE {EV}, det AS (SELECT rec, us, row_number() OVER (PARTITION BY rec ORDER BY us) AS j FROM ev WHERE activity = 'click'), ref AS (SELECT rec, us, row_number() OVER (PARTITION BY rec ORDER BY us) AS i FROM ev WHERE activity = 'view'),
nb AS (SELECT r.rec, r.i, any_value(r.us) AS us, count(d.us) AS below FROM ref r LEFT JOIN det d ON d.rec = r.rec AND d.us < r.us GROUP BY r.rec, r.i),
g AS (SELECT nb.rec, nb.i, below, CASE WHEN nb.us - l.us <= 10800000000 THEN nb.us - l.us END AS lg, CASE WHEN h.us - nb.us <= 10800000000 THEN h.us - nb.us END AS hg FROM nb LEFT JOIN det l ON l.rec = nb.rec AND l.j = below LEFT JOIN det h ON h.rec = nb.rec AND h.j = below + 1),
m AS (SELECT rec, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS gap FROM (SELECT DISTINCT rec FROM ref)
  UNION ALL SELECT m.rec, g.i, CASE WHEN x.gap IS NULL THEN m.taken ELSE list_append(m.taken, x.j) END, x.gap FROM m JOIN g ON g.rec = m.rec AND g.i = m.i + 1,
  LATERAL (SELECT CASE WHEN lf IS NOT NULL AND (hf IS NULL OR lf <= hf) THEN g.below ELSE g.below + 1 END AS j, least(lf, hf) AS gap FROM
    (SELECT CASE WHEN NOT list_contains(m.taken, g.below) THEN g.lg END AS lf, CASE WHEN NOT list_contains(m.taken, g.below + 1) THEN g.hg END AS hf)) x),
t AS (SELECT rec, count(gap) AS tp, median(gap) AS error FROM m GROUP BY rec), n AS (SELECT rec, count(*) FILTER (activity = 'view') AS nr, count(*) FILTER (activity = 'click') AS nd FROM ev WHERE activity IN ('view', 'click') GROUP BY rec)
SELECT n.rec, coalesce(tp, 0) AS tp, CASE WHEN nr > 0 THEN round(coalesce(tp, 0) / nr, 6) END AS sensitivity, CASE WHEN nd > 0 THEN round(coalesce(tp, 0) / nd, 6) END AS ppv, round(error::DOUBLE, 6) AS error_us FROM n LEFT JOIN t ON n.rec = t.rec""")
def nearest_match_tol(spark, sf):
    """Greedy matches within three hours; tests hold them against a plain loop too."""
    ev = events(spark, sf)
    det, ref = ev.where("activity = 'click'").select("rec", "us"), ev.where("activity = 'view'").select("rec", "us")
    matches = nearest_match(det, ref, "rec", "us", 3 * 3.6e9)
    return match_summary(matches, det, ref, "rec").select("rec", "tp", r6("sensitivity", "sensitivity"), r6("ppv", "ppv"), r6("error", "error_us"))


@query("JN1 JN2 PRJ10", f"""WITH {EV}, u AS (SELECT rec, avg(value) AS q FROM ev GROUP BY rec), b AS (SELECT rec, value AS base FROM ev WHERE i = 0)
SELECT ev.rec, ev.event_id, round(ev.value - b.base, 6) AS rise, round(u.q, 6) AS q FROM ev LEFT JOIN b ON ev.rec = b.rec LEFT JOIN u ON ev.rec = u.rec AND ev.rec % 3 <> 0 WHERE ev.i > 0 AND coalesce(u.q > 45, FALSE) AND ev.value > 10""")
def baseline_attach_left_join(spark, sf):
    """Each event with its recording's first value and a quality that some recordings lack; only evaluable ones."""
    from plethora.operators.windows import packet_index

    ev = packet_index(events(spark, sf), "rec", "us", "event_id")
    quality = ev.where("rec % 3 != 0").groupBy("rec").agg(F.avg("value").alias("q"))
    d = jo.attach_first(ev, ["rec"], F.col("i") == 0, "value", "base")
    d = jo.left_validated(d, quality, ["rec"]).withColumns({"first": F.col("i") == 0, "ok": F.col("q") > 45, "level": (F.col("value") > 10).cast("int")})
    return d.where(cl.evaluable("first", "ok", "level")).select("rec", "event_id", r6(F.col("value") - F.col("base"), "rise"), r6("q", "q"))


@query("JN8 AGG2 EVL1", """WITH s AS (SELECT s_nationkey AS fold_key, l_discount * 10 + l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), f AS (SELECT DISTINCT fold_key AS fold FROM s),
t AS (SELECT fold, quantile_cont(q, 0.5) AS thr FROM f JOIN s ON s.fold_key <> f.fold GROUP BY fold)
SELECT fold, round(thr, 6) AS threshold, count(*) AS n, count(*) FILTER (q >= thr) AS shown FROM t JOIN s ON s.fold_key = t.fold GROUP BY fold, thr""")
def loso_threshold_gate(spark, sf):
    """Each nation's line items under the median quality of all other nations: counts of all by range of the quality, less the nation's own."""
    d = read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("key"), (F.col("l_discount") * 10 + F.col("l_quantity")).alias("q"))
    thr = ga.held_out_quantiles(d, "key", "q", {"thr": 0.5})
    mine = d.join(jo.small(thr), F.col("key") == F.col("fold")).groupBy("fold", "thr")
    return mine.agg(F.count(F.lit(1)).alias("n"), F.count_if(cl.gate("q", "thr")).alias("shown")).select("fold", r6("thr", "threshold"), "n", "shown")


@query("JN7", """SELECT o_orderpriority, count(*) FILTER (o_custkey % 3 = 0) AS test, count(*) FILTER (o_custkey % 3 <> 0) AS train FROM orders GROUP BY 1""")
def subject_split_counts(spark, sf):
    """Train and test by sets of customers."""
    o = read(spark, sf, "orders")
    held = o.select("o_custkey").where("o_custkey % 3 = 0")
    a, b = jo.subject_split(o, "o_custkey", held), jo.subject_split(o, "o_custkey", held, inside=False)
    both = a.select("o_orderpriority", F.lit(1).alias("test"), F.lit(0).alias("train")).union(b.select("o_orderpriority", F.lit(0), F.lit(1)))
    return both.groupBy("o_orderpriority").agg(F.sum("test").alias("test"), F.sum("train").alias("train"))


_SWEEP = [0.0, 0.2, 0.4, 0.6, 0.8]
_EST = """e AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice AS ref, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * (0.8 + (o_orderkey * 7919 % 401) / 1000.0::DOUBLE) END AS est,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 104729 % 1000) / 1000.0::DOUBLE END AS q FROM orders)"""


def _estimates(spark, sf):
    """Orders with an estimate of the price (some lack it) and a quality (some lack it): est, ref, q."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        k, "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("ref"), F.when(k % 9 != 0, F.col("o_totalprice") * (0.8 + (k * 7919 % 401) / 1000.0)).alias("est"), F.when(k % 13 != 0, (k * 104729 % 1000) / 1000.0).alias("q"))


def _errors(d, *keys):
    return me.error_table(d, list(keys), "est", "ref")


_BUNDLE = """count(*) AS n, CASE WHEN count(*) >= 3 THEN round(median(abs(est - ref)), 6) END AS md_ae, CASE WHEN count(*) >= 3 THEN round(avg(abs(est - ref)), 6) END AS mae, CASE WHEN count(*) >= 3 THEN round(median(100 * abs(est - ref) / ref), 6) END AS md_pe,
  CASE WHEN count(*) >= 3 THEN round(corr(est, ref), 6) END AS pearson, CASE WHEN count(*) >= 3 THEN round(corr(re, rr), 6) END AS spearman, CASE WHEN count(*) >= 3 THEN round(avg(est - ref), 4) END AS bias, CASE WHEN count(*) >= 3 THEN round(avg(est - ref) - 1.96 * stddev_samp(est - ref), 4) END AS loa_low, CASE WHEN count(*) >= 3 THEN round(avg(est - ref) + 1.96 * stddev_samp(est - ref), 4) END AS loa_high"""


def _rounded(d, *keys):
    places = {"bias": 4, "loa_low": 4, "loa_high": 4}
    return d.select(*keys, "n", *[F.round(c, places.get(c, 6)).alias(c) for c in ("md_ae", "mae", "md_pe", "pearson", "spearman", "bias", "loa_low", "loa_high")])


def _ranked_sql(source: str, by: str = "") -> str:
    """source with re, rr: the mean ranks of estimate and reference in their group."""
    part = f"PARTITION BY {by}" if by else ""
    rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {', '.join(x for x in (by, c) if x)}) - 1) / 2.0"
    return f"(SELECT *, {rank('est')} AS re, {rank('ref')} AS rr FROM ({source}))"


@query("JN11 PRJ8 AGG18", f"""WITH {_EST} SELECT tau, {_BUNDLE} FROM {_ranked_sql("SELECT * FROM e, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _SWEEP) + ") AS g(tau) WHERE est IS NOT NULL AND (tau <= 0 OR q >= tau)", "tau")} GROUP BY tau""")
def threshold_sweep(spark, sf):
    d = jo.grid(_estimates(spark, sf), jo.values(spark, [(t,) for t in _SWEEP], "tau double"))
    return _rounded(_errors(d.where(cl.kept("est", "q", "tau")), "tau"), "tau")


@query("AGG18", f"WITH {_EST} SELECT {_BUNDLE} FROM {_ranked_sql('SELECT * FROM e WHERE est IS NOT NULL')}")
def bland_altman(spark, sf):
    return _rounded(_errors(_estimates(spark, sf)))


@query("AGG18 AGG8 AGG12", f"WITH {_EST} SELECT o_orderpriority, {_BUNDLE} FROM {_ranked_sql('SELECT * FROM e WHERE est IS NOT NULL', 'o_orderpriority')} GROUP BY o_orderpriority")
def error_metrics_by_segment(spark, sf):
    return _rounded(_errors(_estimates(spark, sf), "o_orderpriority"), "o_orderpriority")


@query("AGG9", f"""WITH {_EST}, r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY est) + (count(*) OVER (PARTITION BY o_orderpriority, est) - 1) / 2.0 AS x, rank() OVER (PARTITION BY o_orderpriority ORDER BY q) + (count(*) OVER (PARTITION BY o_orderpriority, q) - 1) / 2.0 AS y FROM e WHERE est IS NOT NULL AND q IS NOT NULL)
SELECT o_orderpriority, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY o_orderpriority""")
def spearman_by_segment(spark, sf):
    return me.spearman(_estimates(spark, sf), ["o_orderpriority"], "est", "q").withColumn("spearman", r6("spearman"))


_LEVELS = f"""{_EST}, l AS (SELECT *, CASE WHEN ref >= 325000 THEN 3 WHEN ref >= 175000 THEN 2 ELSE 1 END AS rl, CASE WHEN est >= 325000 THEN 3 WHEN est >= 175000 THEN 2 ELSE 1 END AS sl FROM e WHERE est IS NOT NULL)"""


def _levels(spark, sf):
    return _estimates(spark, sf).where("est IS NOT NULL").withColumns({"rl": cl.band(F.col("ref"), 325000, 175000), "sl": cl.band(F.col("est"), 325000, 175000)})


@query("AGG19 PRJ11", f"""WITH {_LEVELS}, c AS (SELECT o_orderpriority AS p, rl, sl, count(*) AS m FROM l GROUP BY ALL), n AS (SELECT p, sum(m) AS n, sum(m) FILTER (rl = sl) / sum(m) AS po FROM c GROUP BY p),
pe AS (SELECT a.p, sum(a.m * b.m) AS s FROM (SELECT p, rl AS k, sum(m) AS m FROM c GROUP BY ALL) a JOIN (SELECT p, sl AS k, sum(m) AS m FROM c GROUP BY ALL) b ON a.p = b.p AND a.k = b.k GROUP BY a.p)
SELECT n.p AS o_orderpriority, n::BIGINT AS n, round(po, 6) AS agreement, round((po - s / n / n) / (1 - s / n / n), 6) AS kappa FROM n JOIN pe ON n.p = pe.p""")
def cohen_kappa(spark, sf):
    k = me.kappa(me.confusion(_levels(spark, sf), ["o_orderpriority"], "rl", "sl"), ["o_orderpriority"])
    return k.select("o_orderpriority", "n", r6("agreement", "agreement"), r6("kappa", "kappa"))


@query("AGG11 AGG10", f"""WITH {_LEVELS} SELECT o_orderpriority, round(avg((sl > 1)::INT) FILTER (rl = 1), 6) AS false_alarm, round(avg((sl = 1)::INT) FILTER (rl > 1), 6) AS miss FROM l GROUP BY 1""")
def false_alarm_miss(spark, sf):
    d = _levels(spark, sf).groupBy("o_orderpriority").agg(*me.alarm_rates("rl", "sl"))
    return d.select("o_orderpriority", r6("false_alarm", "false_alarm"), r6("miss", "miss"))


_LABELS = "s AS (SELECT toxic AS y, quality, length(d.text) // 200 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.char_length("text") / 200).alias("score"))
    return d.join(read(spark, sf, "labels"), "doc_id").select(F.col("toxic").alias("y"), "quality", "score")


@query("AGG20 EVL4", f"""WITH {_LABELS} SELECT a.quality, count(*) FILTER (TRUE) // count(*) AS one, round(avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auroc FROM s a JOIN s b ON a.quality = b.quality WHERE a.y = 1 AND b.y = 0 GROUP BY a.quality""")
def auroc_ranksum(spark, sf):
    d = me.auroc(_labelled(spark, sf), ["quality"], "score", "y").where("auroc IS NOT NULL")
    return d.select("quality", F.lit(1).cast("long").alias("one"), r6("auroc", "auroc"))


@query("AGG20 EVL4", f"""WITH {_LABELS}, t AS (SELECT score, sum(y) AS p, count(*) AS m FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) / sum(m) OVER (ORDER BY score DESC) AS prec FROM t)
SELECT round(sum(p * prec) / sum(p), 6) AS average_precision FROM c""")
def average_precision(spark, sf):
    return me.average_precision(_labelled(spark, sf), [], "score", "y").select(r6("average_precision", "average_precision"))


@query("AGG24 F15-F17", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - list_avg(embedding::DOUBLE[])) AS s FROM embeddings),
p AS (SELECT vec_id, label, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM v), t AS (SELECT label, pos, median(x) AS m FROM p GROUP BY label, pos),
c AS (SELECT p.vec_id, p.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12) AS c FROM p JOIN t ON p.label = t.label AND p.pos = t.pos GROUP BY p.vec_id, p.label)
SELECT label, count(*) AS n, round(avg(c), 6) AS corr_mean, round(quantile_cont(c, 0.1), 6) AS corr_p10, round(avg((c < 0.8)::INT), 6) AS frac_lt08 FROM c GROUP BY label""")
def template_corr(spark, sf):
    d = me.template_correlation(read(spark, sf, "embeddings"), ["label"], "embedding")
    return d.select("label", "n", *[r6(c, c) for c in ("corr_mean", "corr_p10", "frac_lt08")])


@query("AGG2 AGG4 AGG5 AGG6 AGG7 F18-F19 F22-F23", """WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS mu FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd, round(sum(pow(l_quantity - mu, 3)) / count(*) / pow(stddev_pop(l_quantity), 3), 6) AS skew, round(kurtosis_pop(l_quantity), 6) AS kurt,
round(max(l_quantity) - min(l_quantity), 6) AS p2p, round(quantile_cont(l_quantity, 0.99) - quantile_cont(l_quantity, 0.01), 6) AS p99_p1 FROM lineitem JOIN m ON l_returnflag = f GROUP BY 1""")
def waveform_moments(spark, sf):
    q, d = "l_quantity", read(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    m = d.groupBy("l_returnflag").agg(r6(F.avg(q), "mean"), r6(F.stddev_pop(q), "sd_pop"), r6(F.stddev_samp(q), "sd"), r6(F.skewness(q), "skew"), r6(F.kurtosis(q), "kurt"), r6(F.max(q) - F.min(q), "p2p"))
    return os.with_quantiles(m, d, ["l_returnflag"], q, {"p99": 0.99, "p1": 0.01}).withColumn("p99_p1", r6(F.col("p99") - F.col("p1"))).drop("p99", "p1")


@query("AGG13 AGG14 AGG15", """SELECT coalesce(event_type, 'all') AS event_type, coalesce(cohort, 'all') AS cohort, grouping(event_type) * 2 + grouping(cohort) AS level, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 6) AS med FROM (SELECT *, (user_id % 5)::VARCHAR AS cohort FROM events)
GROUP BY GROUPING SETS ((event_type, cohort), (event_type), ())""")
def grouping_sets_summary(spark, sf):
    d = events(spark, sf).withColumn("cohort", (F.col("rec") % 5).cast("string"))
    a, b = F.col("activity"), F.col("cohort")
    g = d.groupingSets([[a, b], [a], []], a, b).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct("rec").alias("users"))
    # Medians don't add up from the finer sets: a value is counted once in each set that it belongs to.
    level = lambda n, x, y: F.struct(F.lit(n).cast("long").alias("level"), x.alias("activity"), y.alias("cohort"))
    none = F.lit(None).cast("string")
    values = d.groupBy("activity", "cohort", "value").agg(F.count(F.lit(1)).alias("m"))
    sets = values.select("value", "m", F.explode(F.array(level(0, a, b), level(1, a, none), level(3, none, none))).alias("s")).select("value", "m", "s.*")
    g = os.with_quantiles(g.withColumn("level", F.col("level").cast("long")), sets, ["level", "activity", "cohort"], "value", {"med": 0.5}, "m")
    return g.select(F.coalesce("activity", F.lit("all")).alias("event_type"), F.coalesce("cohort", F.lit("all")).alias("cohort"), "level", "n", "users", r6("med", "med"))


@query("AGG17 SET4", "SELECT sum(c)::BIGINT AS total, count(*) AS n FROM (SELECT o_custkey, min(o_orderkey) AS first, arg_min(o_shippriority, o_orderkey) AS c FROM (SELECT *, 1 AS o_shippriority FROM orders) GROUP BY 1)".replace("arg_min(o_shippriority, o_orderkey)", "any_value(o_shippriority)"))
def dedupe_then_sum(spark, sf):
    """One row per customer, then the sum."""
    d = read(spark, sf, "orders").select("o_custkey", F.lit(1).alias("c")).dropDuplicates(["o_custkey"])
    return d.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"))


@query("AGG15", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def value_histogram(spark, sf):
    return me.confusion(read(spark, sf, "orders"), [], "o_orderpriority", "o_orderstatus").select(F.col("ref").alias("o_orderpriority"), F.col("shown").alias("o_orderstatus"), F.col("m").alias("n"))


_GRID = ra.coverage_grid(0.10, 1.0, 0.05)
_CURVE = f"""{_EST}, m AS (SELECT 'q' AS method, o_orderkey, o_orderpriority, abs(est - ref) AS ae, coalesce(q, -1) AS score FROM e WHERE est IS NOT NULL UNION ALL SELECT 'oracle', o_orderkey, o_orderpriority, abs(est - ref), -abs(est - ref) FROM e WHERE est IS NOT NULL
  UNION ALL SELECT 'price', o_orderkey, o_orderpriority, abs(est - ref), -est FROM e WHERE est IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY method) AS n FROM m), g AS (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in _GRID)}]) AS c),
v AS (SELECT method, c, count(*) AS k, median(ae) AS risk FROM k, g WHERE round_even(c * n, 0) BETWEEN 5 AND n AND rn <= round_even(c * n, 0) GROUP BY method, c)"""


def _methods(spark, sf):
    d = _estimates(spark, sf).where("est IS NOT NULL").withColumn("ae", F.abs(F.col("est") - F.col("ref")))
    scores = F.array(F.struct(F.lit("q").alias("method"), F.coalesce("q", F.lit(-1.0)).alias("score")), F.struct(F.lit("oracle").alias("method"), (-F.col("ae")).alias("score")), F.struct(F.lit("price").alias("method"), (-F.col("est")).alias("score")))
    return d.select("o_orderkey", "o_orderpriority", "ae", F.explode(scores).alias("s")).select("o_orderkey", "o_orderpriority", "ae", "s.method", "s.score")


def _curve(spark, sf):
    return ra.risk_coverage(_methods(spark, sf), ["method"], "score", "ae", _GRID, ["o_orderkey"])


@query("TOP1 WIN10", f"WITH {_CURVE} SELECT method, c, k, round(risk, 6) AS risk FROM v")
def risk_coverage_curve(spark, sf):
    return _curve(spark, sf).withColumn("risk", r6("risk"))


@query("TOP6", f"WITH {_CURVE}, a AS (SELECT method, avg(risk) AS aurc FROM v GROUP BY method) SELECT method, round(aurc, 6) AS aurc, round((50000 - aurc) / (50000 - (SELECT aurc FROM a WHERE method = 'oracle')), 6) AS gap_closed FROM a")
def aurc_gap_closed(spark, sf):
    return ra.aurc(_curve(spark, sf), [], "method", 50000.0).select("method", r6("aurc", "aurc"), r6("gap_closed", "gap_closed"))


@query("TOP2", f"""WITH {_EST}, m AS (SELECT abs(est - ref) AS ae, round_even(coalesce(q, -1) * 10, 0) AS score, md5('tie' || o_orderkey) AS tie, o_orderkey FROM e WHERE est IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie, o_orderkey) AS rn, count(*) OVER () AS n FROM m),
g AS (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in ra.coverage_grid(0.05, 1.0, 0.05))}]) AS c) SELECT c, count(*) AS k, round(median(ae), 6) AS risk FROM k, g WHERE round_even(c * n, 0) BETWEEN 20 AND n AND rn <= round_even(c * n, 0) GROUP BY c""")
def risk_coverage_seeded_ties(spark, sf):
    """Coarse scores; ties break by a seeded hash."""
    d = _estimates(spark, sf).where("est IS NOT NULL").select(F.lit(0).alias("one"), "o_orderkey", F.abs(F.col("est") - F.col("ref")).alias("ae"), F.rint(F.coalesce("q", F.lit(-1.0)) * 10).alias("score"), F.md5(F.concat(F.lit("tie"), F.col("o_orderkey").cast("string"))).alias("tie"))
    c = ra.risk_coverage(d, ["one"], "score", "ae", ra.coverage_grid(0.05, 1.0, 0.05), ["tie", "o_orderkey"], least=20)
    return c.select("c", "k", r6("risk", "risk"))


@query("TOP4", """WITH s AS (SELECT l_returnflag, CASE WHEN l_orderkey % 4 <> 0 THEN l_quantity + l_discount END AS score FROM lineitem), n AS (SELECT l_returnflag, count(*) AS n, round_even(0.5 * count(*), 0)::BIGINT AS k FROM s GROUP BY 1),
r AS (SELECT l_returnflag, score, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC) AS rn FROM s WHERE score IS NOT NULL)
SELECT n.l_returnflag, n.n, n.k, round(score, 6) AS threshold FROM n JOIN r ON n.l_returnflag = r.l_returnflag AND r.rn = n.k""")
def threshold_keep_share(spark, sf):
    d = read(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 4 != 0, F.col("l_quantity") + F.col("l_discount")).alias("score"))
    return ra.threshold_for_share(d, ["l_returnflag"], "score", 0.5).withColumn("threshold", r6("threshold"))


@query("TOP3 TOP5", f"""WITH {_EST}, k AS (SELECT o_orderpriority, count(*) FILTER (est IS NOT NULL AND q >= 0.6) AS k FROM e GROUP BY 1), r AS (SELECT e.o_orderpriority, abs(est - ref) AS ae, row_number() OVER (PARTITION BY e.o_orderpriority ORDER BY ref, o_orderkey) AS rn, row_number() OVER (PARTITION BY e.o_orderpriority ORDER BY abs(est - ref), o_orderkey) AS best FROM e WHERE est IS NOT NULL)
SELECT r.o_orderpriority, any_value(k) AS k, round(median(ae) FILTER (rn <= k), 6) AS matched, round(median(ae) FILTER (best <= k), 6) AS oracle FROM r JOIN k ON r.o_orderpriority = k.o_orderpriority GROUP BY 1""")
def matched_coverage(spark, sf):
    """As many rows as the gate keeps: those of the least price, and the best possible ones."""
    d = _estimates(spark, sf).where("est IS NOT NULL").select("o_orderkey", "o_orderpriority", F.abs(F.col("est") - F.col("ref")).alias("ae"), "est", "ref", "q")
    k = d.groupBy("o_orderpriority").agg(F.count_if(cl.kept("est", "q", 0.6)).alias("k"))
    for rank, order, out in (("_rn", "ref", "matched"), ("_best", "ae", "oracle")):
        placed = os.running(d.select("o_orderkey", "o_orderpriority", "ae", "ref"), ["o_orderpriority"], [F.asc(order), F.asc("o_orderkey")], rank)
        inside = placed.join(jo.small(k.select("o_orderpriority", "k")), "o_orderpriority").where(F.col(rank) <= F.col("k"))
        k = os.with_quantiles(k, inside, ["o_orderpriority"], "ae", {out: 0.5})
    return k.select("o_orderpriority", "k", r6("matched", "matched"), r6("oracle", "oracle"))


@query("TOP7 SET2", f"""WITH {_EST}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY q DESC, o_orderkey) <= round_even(0.5 * count(*) OVER (PARTITION BY o_orderpriority), 0) AS kept FROM e WHERE est IS NOT NULL AND q IS NOT NULL)
SELECT o_orderpriority, kept, count(*) AS n, round(median(ref), 6) AS ref, round(median(abs(est - ref)), 6) AS ae FROM r GROUP BY 1, 2""")
def kept_vs_dropped(spark, sf):
    d = ra.split_at_half(_estimates(spark, sf).where("est IS NOT NULL AND q IS NOT NULL"), ["o_orderpriority"], "q", "o_orderkey")
    keys = ["o_orderpriority", "kept"]
    d = stage(d.select(*keys, "ref", F.abs(F.col("est") - F.col("ref")).alias("ae")), "halves")
    g = os.with_medians(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), d, keys, {"med_ref": F.col("ref"), "med_ae": F.col("ae")})
    return g.select(*keys, "n", r6("med_ref", "ref"), r6("med_ae", "ae"))


_CONF = f"""{_EST}, s AS (SELECT o_orderpriority, o_custkey % 2 = 0 AS calib, abs(est - ref) / (1 + q) AS sc, est, ref, q FROM e WHERE est IS NOT NULL AND q IS NOT NULL), n AS (SELECT o_orderpriority, count(*) AS n, ceil((count(*) + 1) * 0.9::DOUBLE) AS k FROM s WHERE calib GROUP BY 1),
r AS (SELECT o_orderpriority, sc, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sc) AS rn FROM s WHERE calib), t AS (SELECT n.o_orderpriority, n.n, r.sc AS q FROM n JOIN r ON n.o_orderpriority = r.o_orderpriority AND rn = k)"""


def _scored(spark, sf):
    d = _estimates(spark, sf).where("est IS NOT NULL AND q IS NOT NULL")
    return d.withColumns({"calib": F.col("o_custkey") % 2 == 0, "sc": F.abs(F.col("est") - F.col("ref")) / (1 + F.col("q"))})


@query("TOP8", f"WITH {_CONF} SELECT o_orderpriority, n, round(q, 6) AS q FROM t")
def conformal_quantile_by_group(spark, sf):
    return ra.conformal_quantile(_scored(spark, sf).where("calib"), ["o_orderpriority"], "sc", 0.1).withColumn("q", r6("q"))


@query("ML11", f"""WITH {_CONF} SELECT s.o_orderpriority, count(*) AS n, round(avg((abs(est - ref) <= t.q * (1 + s.q))::INT), 6) AS coverage, round(median(2 * t.q * (1 + s.q)), 6) AS width, count(*) FILTER (2 * t.q * (1 + s.q) <= 150000) AS narrow,
  round(avg(abs(est - ref)) FILTER (2 * t.q * (1 + s.q) <= 150000), 6) AS narrow_mae FROM s JOIN t ON s.o_orderpriority = t.o_orderpriority WHERE NOT calib GROUP BY 1""")
def selective_width(spark, sf):
    """Split conformal intervals by customers, adaptive width; what is left where intervals are narrow."""
    d = _scored(spark, sf)
    t = jo.small(ra.conformal_quantile(d.where("calib"), ["o_orderpriority"], "sc", 0.1).select("o_orderpriority", F.col("q").alias("cq")))
    d = d.where("NOT calib").join(t, "o_orderpriority").withColumns({"half": F.col("cq") * (1 + F.col("q")), "ae": F.abs(F.col("est") - F.col("ref"))})
    narrow = 2 * F.col("half") <= 150000
    g = d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("ae") <= F.col("half")).cast("double")), "coverage"), F.count_if(narrow).alias("narrow"), r6(F.avg(F.when(narrow, F.col("ae"))), "narrow_mae"))
    return os.with_quantiles(g, d, ["o_orderpriority"], 2 * F.col("half"), {"width": 0.5}).withColumn("width", r6("width"))


@query("TOP10", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.2) AS q FROM lineitem GROUP BY 1) SELECT l.l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag WHERE l_extendedprice <= q GROUP BY 1""")
def quiet_quintile(spark, sf):
    return ra.quiet_subset(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity"), "mean"))


@query("EVL6 AGG10", f"""WITH {_EST} SELECT o_orderpriority, count(*) AS n, count(est) AS computable, round(avg((abs(est - ref) <= 5000)::INT), 6) AS of_computable, round(count(*) FILTER (abs(est - ref) <= 5000) / count(*), 6) AS of_all, round(count(*) FILTER (abs(est - ref) <= 0.1 * ref) / count(*), 6) AS within_10pct FROM e GROUP BY 1""")
def good_prevalence(spark, sf):
    good = F.abs(F.col("est") - F.col("ref")) <= 5000
    n = F.count(F.lit(1))
    return _estimates(spark, sf).groupBy("o_orderpriority").agg(n.alias("n"), F.count("est").alias("computable"), r6(F.avg(good.cast("double")), "of_computable"), r6(F.count_if(good) / n, "of_all"), r6(F.count_if(F.abs(F.col("est") - F.col("ref")) <= 0.1 * F.col("ref")) / n, "within_10pct"))


_NATIONS = list(range(25))
#: Bootstrap replicates and half splits, as many as the reference draws.
_BOOT, _SPLITS = 1000, 200


def _draw_sql(kind: str) -> str:
    import numpy as np

    random, rows = np.random.default_rng(rs.SEED), []
    for rep in range(_BOOT if kind == "boot" else _SPLITS):
        if kind == "boot":
            drawn, n = np.unique(random.choice(25, 25), return_counts=True)
            rows += [f"({rep}, {i}, {m})" for i, m in zip(drawn.tolist(), n.tolist())]
        else:
            rows += [f"({rep}, {i}, {place < 12})" for place, i in enumerate(random.permutation(25).tolist())]
    return ", ".join(rows)


def _draws_sql(n: int) -> str:
    """Replicates that draw n numbered cohorts with replacement, as rows (rep, cohort, mult)."""
    import numpy as np

    random, rows = np.random.default_rng(rs.SEED), []
    for rep in range(_BOOT):
        drawn, m = np.unique(random.choice(n, n), return_counts=True)
        rows += [f"({rep}, {i}, {k})" for i, k in zip(drawn.tolist(), m.tolist())]
    return ", ".join(rows)


_COHORT = f"""{_EST}, s AS (SELECT o_custkey % 25 AS subj, abs(est - ref) AS ae, q FROM e WHERE est IS NOT NULL)"""


def _cohort(spark, sf):
    return _estimates(spark, sf).where("est IS NOT NULL").select((F.col("o_custkey") % 25).alias("subj"), F.abs(F.col("est") - F.col("ref")).alias("ae"), "q")


@query("SMP1 JN9 AGG3", f"""WITH {_COHORT}, d(rep, subj, mult) AS (VALUES {_draw_sql("boot")}), x AS (SELECT rep, ae FROM s JOIN d ON s.subj = d.subj, range(mult)), m AS (SELECT rep, median(ae) AS med FROM x GROUP BY rep)
SELECT count(*) AS reps, round(quantile_cont(med, 0.025), 6) AS lo, round(quantile_cont(med, 0.975), 6) AS hi FROM m""")
def bootstrap_median_ci(spark, sf):
    """Cohorts of customers drawn with replacement: the medians of all replicates from counts of cohorts by range of the error."""
    reps = rp.medians(_cohort(spark, sf), [], "ae", rp.drawn(rs.draw_matrix(len(_NATIONS), _BOOT), _NATIONS, "subj"), "med")
    return rs.interval(reps, "med").select("reps", r6("lo", "lo"), r6("hi", "hi"))


@query("SMP3 AGG19", f"""WITH {_LEVELS}, d(rep, subj, mult) AS (VALUES {_draw_sql("boot")}), c AS (SELECT rep, rl, sl, sum(mult) AS m FROM l JOIN d ON l.o_custkey % 25 = d.subj GROUP BY ALL), n AS (SELECT rep, sum(m) AS n, sum(m) FILTER (rl = sl) / sum(m) AS po FROM c GROUP BY rep),
pe AS (SELECT a.rep, sum(a.m * b.m) AS s FROM (SELECT rep, rl AS k, sum(m) AS m FROM c GROUP BY ALL) a JOIN (SELECT rep, sl AS k, sum(m) AS m FROM c GROUP BY ALL) b ON a.rep = b.rep AND a.k = b.k GROUP BY a.rep)
SELECT n.rep, n::BIGINT AS n, round((po - s / n / n) / (1 - s / n / n), 6) AS kappa, round(po, 6) AS agreement, round(fa, 6) AS false_alarm FROM n JOIN pe ON n.rep = pe.rep JOIN (SELECT rep, coalesce(sum(m) FILTER (rl = 1 AND sl > 1), 0) / sum(m) FILTER (rl = 1) AS fa FROM c GROUP BY rep) f ON n.rep = f.rep WHERE n >= 10""")
def bootstrap_kappa(spark, sf):
    """Confusion counts per cohort are made once and weighted by the draws."""
    counts = _levels(spark, sf).groupBy((F.col("o_custkey") % 25).alias("subj"), F.col("rl").alias("ref"), F.col("sl").alias("shown")).agg(F.count(F.lit(1)).alias("m"))
    d = ga.bootstrap_agreement(counts, [], rs.bootstrap_draws(spark, _NATIONS, _BOOT, "subj"), "subj")
    return d.select("rep", "n", r6("kappa", "kappa"), r6("agreement", "agreement"), r6("false_alarm", "false_alarm"))


@query("SMP5 TOP4 PRJ8", f"""WITH {_COHORT}, d(rep, subj, calib) AS (VALUES {_draw_sql("half")}), x AS (SELECT rep, calib, ae, q FROM s JOIN d ON s.subj = d.subj), n AS (SELECT rep, round_even(0.5 * count(*), 0) AS k FROM x WHERE calib GROUP BY rep),
r AS (SELECT rep, q, row_number() OVER (PARTITION BY rep ORDER BY q DESC NULLS LAST) AS rn FROM x WHERE calib), t AS (SELECT n.rep, r.q AS thr FROM n JOIN r ON n.rep = r.rep AND rn = k)
SELECT x.rep, round(thr, 6) AS threshold, round(count(*) FILTER (q >= thr) / count(*), 6) AS coverage, round(median(ae) FILTER (q >= thr), 6) AS md_ae FROM x JOIN t ON x.rep = t.rep WHERE NOT calib GROUP BY x.rep, thr""")
def half_split_calibration(spark, sf):
    """A threshold from half the cohorts, applied to the others: all splits at once from counts of cohorts by range."""
    g = rp.calibrated_splits(_cohort(spark, sf), _NATIONS, "subj", "q", "ae", rs.half_matrix(len(_NATIONS), _SPLITS), 0.5)
    return g.select("rep", r6("threshold", "threshold"), r6("coverage", "coverage"), r6("md", "md_ae"))


@query("SMP6 JN8 TOP4", f"""WITH {_COHORT}, t AS (SELECT f.subj AS fold, quantile_disc(s.q, 0.5) AS thr FROM (SELECT DISTINCT subj FROM s) f JOIN s ON s.subj <> f.subj WHERE s.q IS NOT NULL GROUP BY f.subj)
SELECT fold, round(thr, 6) AS threshold, count(*) AS n, round(median(ae) FILTER (q >= thr), 6) AS md_ae FROM t JOIN s ON s.subj = t.fold GROUP BY fold, thr""")
def lopo_calibration(spark, sf):
    """Each cohort under a threshold from all others: the least quality that at least half of their rows don't exceed."""
    d = _cohort(spark, sf)
    t = rp.select(d, [], "q", rp.left_out(_NATIONS, "subj"), lambda n, low, high: {"thr": np.where(n > 0, np.ceil(0.5 * n) - 1, np.nan)}).where("thr IS NOT NULL").select(F.col("column").cast("long").alias("fold"), "thr")
    mine = stage(d.join(jo.small(t), F.col("subj") == F.col("fold")), "held")
    g = os.with_quantiles(mine.groupBy("fold", "thr").agg(F.count(F.lit(1)).alias("n")), mine.where(cl.gate("q", "thr")), ["fold"], "ae", {"m": 0.5})
    return g.select("fold", r6("thr", "threshold"), "n", r6("m", "md_ae"))


@query("AGG9", f"""WITH {_COHORT}, d(rep, subj, mult) AS (VALUES {_draw_sql("boot")}), x AS (SELECT rep, s.ae, s.q FROM s JOIN d ON s.subj = d.subj, range(mult) WHERE q IS NOT NULL), r AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY ae) + (count(*) OVER (PARTITION BY rep, ae) - 1) / 2.0 AS a, rank() OVER (PARTITION BY rep ORDER BY q) + (count(*) OVER (PARTITION BY rep, q) - 1) / 2.0 AS b FROM x)
SELECT rep, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY rep""")
def tracking_bootstrap(spark, sf):
    """Ranks change with each replicate: a value's rank is the product of its prefix counts by cohort with the cohorts' draws."""
    d = rp.spearman_drawn(_cohort(spark, sf), [], "ae", "q", rs.draw_matrix(len(_NATIONS), _BOOT), _NATIONS, "subj")
    return d.select(F.col("column").alias("rep"), "n", r6("spearman", "spearman"))


@query("EVL3 TOP1", f"""WITH {_CURVE.replace("PARTITION BY method", "PARTITION BY method, o_orderpriority").replace("v AS (SELECT method, c,", "v AS (SELECT method, o_orderpriority, c,").replace("GROUP BY method, c)", "GROUP BY method, o_orderpriority, c)")}, a AS (SELECT method, o_orderpriority, avg(risk) AS aurc FROM v GROUP BY 1, 2)
SELECT method, count(*) AS groups, round(median(aurc), 6) AS median_aurc, round(min(aurc), 6) AS least_aurc FROM a GROUP BY method""")
def within_group_robustness(spark, sf):
    c = ra.risk_coverage(_methods(spark, sf), ["method", "o_orderpriority"], "score", "ae", _GRID, ["o_orderkey"])
    a = ra.aurc(c, ["o_orderpriority"], "method", 0.0)
    return a.groupBy("method").agg(F.count(F.lit(1)).alias("groups"), r6(F.median("aurc"), "median_aurc"), r6(F.min("aurc"), "least_aurc"))


_GATES = f"""{_EST}, b AS (SELECT *, o_custkey % 10 AS subj, -est AS low, 1.1 * est AS est1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS base, CASE WHEN ref >= 325000 THEN 3 WHEN ref >= 175000 THEN 2 ELSE 1 END AS rl, CASE WHEN est >= 325000 THEN 3 WHEN est >= 175000 THEN 2 ELSE 1 END AS sl,
  CASE WHEN 1.1 * est >= 325000 THEN 3 WHEN 1.1 * est >= 175000 THEN 2 ELSE 1 END AS sl1 FROM e WHERE est IS NOT NULL),
t AS (SELECT f.subj AS fold, quantile_cont(b.q, 0.5) AS t50, quantile_cont(b.q, 0.75) AS t25, quantile_cont(b.low, 0.5) AS e50, quantile_cont(b.low, 0.75) AS e25 FROM (SELECT DISTINCT subj FROM b) f JOIN b ON b.subj <> f.subj GROUP BY f.subj),
g AS (SELECT *, max(CASE WHEN base THEN q END) OVER (PARTITION BY o_custkey) AS bq, max(CASE WHEN base THEN low END) OVER (PARTITION BY o_custkey) AS bl FROM b),
h AS (SELECT g.*, TRUE AS everything, coalesce(q >= t50 AND bq >= t50, FALSE) AS consistent50, coalesce(q >= t25 AND bq >= t25, FALSE) AS consistent25, low >= e50 AND bl >= e50 AS low50, low >= e25 AND bl >= e25 AS low25 FROM g JOIN t ON g.subj = t.fold)"""
#: Rules by name: the level and the score that they show, and the gate.
_RULES = {"v1": ("sl1", "est1", "everything"), "v2": ("sl", "est", "everything")} | {n: ("sl", "est", n) for n in ("consistent50", "consistent25", "low50", "low25")}


def _gated(spark, sf):
    d = _levels(spark, sf).withColumns({"subj": F.col("o_custkey") % 10, "base": F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1, "low": -F.col("est"), "est1": 1.1 * F.col("est")})
    d = stage(d.withColumn("sl1", cl.band(F.col("est1"), 325000, 175000)), "minutes")
    d = ga.consistency_gates(d, "subj", "o_custkey", "base", "q", {"consistent50": 0.5, "consistent25": 0.25})
    d = ga.consistency_gates(d, "subj", "o_custkey", "base", "low", {"low50": 0.5, "low25": 0.25})
    return d.withColumn("everything", F.lit(True))


@query("EVL1 JN2 JN8", f"WITH {_GATES} SELECT subj, count(*) AS n, count(*) FILTER (consistent50) AS at50, count(*) FILTER (consistent25) AS at25 FROM h GROUP BY subj")
def consistency_gate(spark, sf):
    """Orders that reach, with their customer's first order, the quality that other cohorts set."""
    return _gated(spark, sf).groupBy("subj").agg(F.count(F.lit(1)).alias("n"), F.count_if("consistent50").alias("at50"), F.count_if("consistent25").alias("at25"))


_DISPLAY = f"""{_GATES}, r AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, {show} AS shown, rl, {level} AS sl, abs({score} - ref) AS gap, subj FROM h" for n, (level, score, show) in _RULES.items())}),
c AS (SELECT rule, rl, sl, count(*) AS m FROM r WHERE shown GROUP BY ALL), n AS (SELECT rule, sum(m) AS n, sum(m) FILTER (rl = sl) / sum(m) AS po FROM c GROUP BY rule),
pe AS (SELECT a.rule, sum(a.m * b.m) AS s FROM (SELECT rule, rl AS k, sum(m) AS m FROM c GROUP BY ALL) a JOIN (SELECT rule, sl AS k, sum(m) AS m FROM c GROUP BY ALL) b ON a.rule = b.rule AND a.k = b.k GROUP BY a.rule),
f AS (SELECT rule, avg(shown::INT) AS coverage, avg((sl > 1)::INT) FILTER (shown AND rl = 1) AS fa, avg((sl = 1)::INT) FILTER (shown AND rl > 1) AS ms, avg(gap) FILTER (shown) AS mae FROM r GROUP BY rule),
d(rep, subj, mult) AS (VALUES {{draws}}), cs AS (SELECT rule, subj, rl, sl, count(*) AS m FROM r WHERE shown GROUP BY ALL), cr AS (SELECT rule, rep, rl, sl, sum(m * mult) AS m FROM cs JOIN d ON cs.subj = d.subj GROUP BY ALL),
nr AS (SELECT rule, rep, sum(m) AS n, sum(m) FILTER (rl = sl) / sum(m) AS po, coalesce(sum(m) FILTER (rl = 1 AND sl > 1), 0) / sum(m) FILTER (rl = 1) AS fa FROM cr GROUP BY ALL),
pr AS (SELECT a.rule, a.rep, sum(a.m * b.m) AS s FROM (SELECT rule, rep, rl AS k, sum(m) AS m FROM cr GROUP BY ALL) a JOIN (SELECT rule, rep, sl AS k, sum(m) AS m FROM cr GROUP BY ALL) b ON a.rule = b.rule AND a.rep = b.rep AND a.k = b.k GROUP BY ALL),
ci AS (SELECT nr.rule, {", ".join(f"round(quantile_cont({x}, {p}), 6) AS {c}_{e}" for c, x in (("kappa", "(po - s / n / n) / nullif(1 - s / n / n, 0)"), ("agreement", "po"), ("false_alarm", "fa")) for e, p in (("lo", 0.025), ("hi", 0.975)))} FROM nr JOIN pr ON nr.rule = pr.rule AND nr.rep = pr.rep WHERE n >= 10 GROUP BY nr.rule)"""


@query("EVL2 SMP3 AGG10 AGG11 AGG19", "WITH " + _DISPLAY.format(draws=_draws_sql(10)) + """
SELECT f.rule, round(coverage, 6) AS coverage, n::BIGINT AS n, round((po - s / n / n) / nullif(1 - s / n / n, 0), 6) AS kappa, round(po, 6) AS agreement, round(fa, 6) AS false_alarm, round(ms, 6) AS miss, round(mae, 4) AS score_mae, ci.* EXCLUDE (rule) FROM f JOIN n ON f.rule = n.rule JOIN pe ON f.rule = pe.rule JOIN ci ON f.rule = ci.rule""")
def display_rule_evaluation(spark, sf):
    """Two estimates shown always, and one behind gates of quality and of a low estimate, at two target shares: agreement of levels, with intervals over drawn cohorts."""
    draws = rs.bootstrap_draws(spark, list(range(10)), _BOOT, "subj")
    e = ga.evaluate_rules(_gated(spark, sf), _RULES, "rl", "ref", "subj", draws)
    rates = ["kappa", "agreement", "false_alarm"]
    return e.select("rule", r6("coverage", "coverage"), "n", *[r6(c, c) for c in (*rates, "miss")], F.round("score_mae", 4).alias("score_mae"), *[r6(f"{c}_{x}", f"{c}_{x}") for c in rates for x in ("lo", "hi")])


@query("EVL4 AGG20", f"""WITH {_EST}, m AS (SELECT o_orderkey % 2 AS half, abs(est - ref) AS ae, coalesce(q, -1) AS s FROM e WHERE est IS NOT NULL), l AS (SELECT half, lim, (ae <= lim)::INT AS y, s FROM m, (VALUES (5000), (10000), (20000)) AS t(lim)),
x AS (SELECT half, lim, s, sum(y) AS p, count(*) AS k FROM l GROUP BY ALL), w AS (SELECT *, coalesce(sum(k - p) OVER (PARTITION BY half, lim ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x)
SELECT half, lim, round(sum(p * (below + (k - p) / 2)) / (sum(p) * sum(k - p)), 6) AS auroc FROM w GROUP BY half, lim""")
def label_threshold_sensitivity(spark, sf):
    """AUROC of the quality under three limits of what is good."""
    d = _estimates(spark, sf).where("est IS NOT NULL").select((F.col("o_orderkey") % 2).alias("half"), F.abs(F.col("est") - F.col("ref")).alias("ae"), F.coalesce("q", F.lit(-1.0)).alias("s"))
    long = jo.grid(d, jo.values(spark, [(5000,), (10000,), (20000,)], "lim int")).withColumn("y", (F.col("ae") <= F.col("lim")).cast("int"))
    return me.auroc(long, ["half", "lim"], "s", "y").select("half", "lim", r6("auroc", "auroc"))


#: Five participants times twelve months.
_BLOCKS = 60


@query("SMP2 AGG3 PRJ15", f"""WITH {_EST}, b AS (SELECT (e.o_custkey % 5) * 12 + month(o_orderdate) - 1 AS block, abs(est - ref) AS ae, coalesce(q >= 0.4, FALSE) AS good FROM e JOIN orders USING (o_orderkey) WHERE est IS NOT NULL), d(rep, block, mult) AS (VALUES {_draws_sql(_BLOCKS)}),
x AS (SELECT rep, ae, good FROM b JOIN d ON b.block = d.block, range(mult)), m AS (SELECT rep, median(ae) AS none, median(ae) FILTER (good) AS gated FROM x GROUP BY rep)
SELECT count(*) AS reps, round(quantile_cont(none, 0.025), 4) AS none_lo, round(quantile_cont(none, 0.975), 4) AS none_hi, round(quantile_cont(gated, 0.025), 4) AS gated_lo, round(quantile_cont(gated, 0.975), 4) AS gated_hi,
  round(quantile_cont(none - gated, 0.025), 4) AS reduction_lo, round(quantile_cont(none - gated, 0.975), 4) AS reduction_hi FROM m""")
def block_bootstrap(spark, sf):
    """Blocks of a participant's month drawn with replacement: median errors with and without the gate, and by how much it lowers them."""
    month = read(spark, sf, "orders").select("o_orderkey", ((F.col("o_custkey") % 5) * 12 + F.month("o_orderdate") - 1).alias("block"))
    d = _estimates(spark, sf).where("est IS NOT NULL").join(month, "o_orderkey").select("block", F.abs(F.col("est") - F.col("ref")).alias("ae"), F.coalesce(F.col("q") >= 0.4, F.lit(False)).alias("good"))
    long = d.select("block", "ae", F.explode(F.array(F.lit("none"), F.when(F.col("good"), "gated"))).alias("which")).where("which IS NOT NULL")
    reps = rp.medians(long, ["which"], "ae", rp.drawn(rs.draw_matrix(_BLOCKS, _BOOT), list(range(_BLOCKS)), "block"), "med")
    meds = stage(reps.groupBy("column").agg(*[F.max(F.when(F.col("which") == w, F.col("med"))).alias(w) for w in ("none", "gated")]), "medians")
    ends = [F.round(F.percentile(c, p), 4).alias(f"{n}_{e}") for n, c in (("none", F.col("none")), ("gated", F.col("gated")), ("reduction", F.col("none") - F.col("gated"))) for e, p in (("lo", 0.025), ("hi", 0.975))]
    return meds.agg(F.count(F.lit(1)).alias("reps"), *ends)


@query("SMP6 TOP4 PRJ8", f"""WITH {_EST}, s AS (SELECT o_orderkey % 2 AS site, abs(est - ref) AS ae, q FROM e WHERE est IS NOT NULL), n AS (SELECT site, round_even(0.5 * count(*), 0) AS k FROM s GROUP BY site),
r AS (SELECT site, q, row_number() OVER (PARTITION BY site ORDER BY q DESC NULLS LAST) AS rn FROM s), t AS (SELECT r.site, q AS thr FROM r JOIN n ON r.site = n.site AND rn = k)
SELECT t.site || '->' || s.site AS direction, round(any_value(thr), 6) AS threshold, round(count(*) FILTER (q >= thr) / count(*), 6) AS coverage, round(median(ae) FILTER (q >= thr), 4) AS md_ae, round(median(ae), 4) AS no_gate FROM t JOIN s ON t.site <> s.site GROUP BY t.site, s.site""")
def threshold_transfer(spark, sf):
    """Thresholds set on all windows of one site, applied to the other, both ways."""
    d = stage(_estimates(spark, sf).where("est IS NOT NULL").select((F.col("o_orderkey") % 2).alias("site"), F.abs(F.col("est") - F.col("ref")).alias("ae"), "q"), "sites")
    t = ra.threshold_for_share(d, ["site"], "q", 0.5).select(F.col("site").alias("source"), "threshold")
    x = stage(d.join(jo.small(t), F.col("site") != F.col("source")).withColumn("direction", F.concat_ws("->", F.col("source").cast("string"), F.col("site").cast("string"))), "applied")
    shown = cl.gate("q", "threshold")
    g = x.groupBy("direction").agg(F.max("threshold").alias("threshold"), (F.count_if(shown) / F.count(F.lit(1))).alias("coverage"))
    g = os.with_medians(g, x, ["direction"], {"md_ae": F.when(shown, F.col("ae")), "no_gate": F.col("ae")})
    return g.select("direction", r6("threshold", "threshold"), r6("coverage", "coverage"), F.round("md_ae", 4).alias("md_ae"), F.round("no_gate", 4).alias("no_gate"))


_SUPPLIERS = """sw AS (SELECT s_suppkey AS k, s_nationkey AS subj, round(avg(l_extendedprice), 6) AS est, round(avg(l_quantity) * 1500, 6) AS ref, round(avg(l_discount), 9) AS disc FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2),
sm AS (SELECT k, subj, est, ref, abs(est - ref) AS ae, 'discount' AS method, -disc AS score FROM sw UNION ALL SELECT k, subj, est, ref, abs(est - ref), 'low_estimate', -est FROM sw UNION ALL SELECT k, subj, est, ref, abs(est - ref), 'oracle', -abs(est - ref) FROM sw)"""
_AGAIN = f"""{_SUPPLIERS}, d(rep, subj, mult) AS (VALUES {_draw_sql("boot")}), x AS (SELECT rep, method, est, ref, ae, score, k, again FROM sm JOIN d ON sm.subj = d.subj, range(1, mult + 1) AS t(again)),
r AS (SELECT *, row_number() OVER (PARTITION BY rep, method ORDER BY score DESC, k, again) AS rn, count(*) OVER (PARTITION BY rep, method) AS n FROM x)"""


def _suppliers(spark, sf):
    """Suppliers as windows of 25 subjects: an estimate and a reference of what they sell, under three rankings."""
    d = read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("subj"))
    d = d.agg(F.round(F.avg("l_extendedprice"), 6).alias("est"), F.round(F.avg("l_quantity") * 1500, 6).alias("ref"), F.round(F.avg("l_discount"), 9).alias("disc")).withColumn("ae", F.abs(F.col("est") - F.col("ref")))
    ways = [F.struct(F.lit(n).alias("method"), (-F.col(c)).alias("score")) for n, c in (("discount", "disc"), ("low_estimate", "est"), ("oracle", "ae"))]
    return stage(d.withColumn("_w", F.explode(F.array(*ways))).select("k", "subj", "est", "ref", "ae", "_w.*"), "suppliers")


def _bounds(d):
    return d.select("method", "reps", *[(F.round(c, 3) + 0.0).alias(c) for c in ("lo", "hi", "gain_lo", "gain_hi")])  # no negative zeros


@query("ML7 SMP1 TOP6 JN9", f"""WITH {_AGAIN}, g AS (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in _GRID)}]) AS c), v AS (SELECT rep, method, c, median(ae) AS risk FROM r, g WHERE round_even(c * n, 0) BETWEEN 5 AND n AND rn <= round_even(c * n, 0) GROUP BY ALL),
a AS (SELECT rep, method, avg(risk) AS v FROM v GROUP BY ALL), b AS (SELECT a.method, a.v, o.v - a.v AS gain FROM a JOIN a o ON a.rep = o.rep AND o.method = 'discount')
SELECT method, count(*) AS reps, round(quantile_cont(v, 0.025), 3) AS lo, round(quantile_cont(v, 0.975), 3) AS hi, round(quantile_cont(gain, 0.025), 3) + 0.0 AS gain_lo, round(quantile_cont(gain, 0.975), 3) + 0.0 AS gain_hi FROM b GROUP BY method""")
def paired_gain_bootstrap(spark, sf):
    """Areas under the risk-coverage curve over drawn subjects, and how much lower than that of one method they are in the same draw."""
    return _bounds(el.bootstrap_areas(_suppliers(spark, sf), "method", "score", "ae", "k", "discount", rs.draw_matrix(len(_NATIONS), _BOOT), _NATIONS, "subj"))


@query("SMP4 EVL5 AGG9", f"""WITH {_AGAIN}, p AS (SELECT * FROM r WHERE rn <= round_even(0.5 * n, 0)), q AS (SELECT rep, method, rank() OVER (PARTITION BY rep, method ORDER BY est) + (count(*) OVER (PARTITION BY rep, method, est) - 1) / 2.0 AS a, rank() OVER (PARTITION BY rep, method ORDER BY ref) + (count(*) OVER (PARTITION BY rep, method, ref) - 1) / 2.0 AS b FROM p),
a AS (SELECT rep, method, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS v FROM q GROUP BY rep, method), b AS (SELECT a.method, a.v, a.v - o.v AS gain FROM a JOIN a o ON a.rep = o.rep AND o.method = 'discount')
SELECT method, count(v) AS reps, round(quantile_cont(v, 0.025), 3) AS lo, round(quantile_cont(v, 0.975), 3) AS hi, round(quantile_cont(gain, 0.025), 3) + 0.0 AS gain_lo, round(quantile_cont(gain, 0.975), 3) + 0.0 AS gain_hi FROM b GROUP BY method""")
def tracking_top_half(spark, sf):
    """Rank correlation of estimate and reference among the half that each ranking keeps, over drawn subjects, and the difference to one ranking in the same draw."""
    return _bounds(el.bootstrap_tracking(_suppliers(spark, sf), "method", "score", "est", "ref", "k", 0.5, "discount", rs.draw_matrix(len(_NATIONS), _BOOT), _NATIONS, "subj"))


@query("EVL5 TOP1 AGG8 AGG9", f"""WITH {_EST}, m AS (SELECT o_orderkey, est, ref, 'quality' AS method, coalesce(q, -1) AS score FROM e WHERE est IS NOT NULL UNION ALL SELECT o_orderkey, est, ref, 'low_estimate', -est FROM e WHERE est IS NOT NULL UNION ALL SELECT o_orderkey, est, ref, 'oracle', -abs(est - ref) FROM e WHERE est IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY method) AS n FROM m), p AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY est) + (count(*) OVER (PARTITION BY method, est) - 1) / 2.0 AS a, rank() OVER (PARTITION BY method ORDER BY ref) + (count(*) OVER (PARTITION BY method, ref) - 1) / 2.0 AS b FROM r WHERE rn <= round_even(0.5 * n, 0))
SELECT method, count(*) AS k, round(median(abs(est - ref)), 4) AS md_ae, round(corr(a, b), 6) AS spearman, round(corr(est, ref), 6) AS pearson, round(median(est), 4) AS md_est, round(median(ref), 4) AS md_ref FROM p GROUP BY method""")
def kept_value_tracking(spark, sf):
    """What the kept half tells of the reference under a quality gate, under one that only prefers low estimates, and under the oracle."""
    d = _estimates(spark, sf).where("est IS NOT NULL").withColumn("ae", F.abs(F.col("est") - F.col("ref")))
    ways = [F.struct(F.lit(n).alias("method"), c.alias("score")) for n, c in (("quality", F.coalesce("q", F.lit(-1.0))), ("low_estimate", -F.col("est")), ("oracle", -F.col("ae")))]
    d = d.withColumn("_w", F.explode(F.array(*ways))).select("o_orderkey", "est", "ref", "_w.*")
    k = el.kept_tracking(d, "method", "score", "est", "ref", "o_orderkey", 0.5)
    return k.select("method", "k", F.round("md_ae", 4).alias("md_ae"), r6("spearman", "spearman"), r6("pearson", "pearson"), F.round("md_est", 4).alias("md_est"), F.round("md_ref", 4).alias("md_ref"))
