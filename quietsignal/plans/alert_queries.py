"""Counting, roll-up, thresholds, evaluation and clusters of tagged events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietsignal.functions.score import round_to
from quietsignal.operators import alerts
from quietsignal.plans import workflows
from quietsignal.plans.record_queries import TAGGED, r4, tagged_events
from quietsignal.plans.registry import query


@query("outlier_counter", TAGGED + """ SELECT event_type, count(*) FILTER (tag = 'O')::BIGINT AS outlier_count, count(*) FILTER (tag = 'I')::BIGINT AS unknown_count, count(*) FILTER (tag = 'N')::BIGINT AS normal_count,
count(*) FILTER (tag = 'A')::BIGINT AS ambiguous_count, count(*)::BIGINT AS total, round(100.0::DOUBLE * count(*) FILTER (tag = 'O') / count(*), 4) AS outlier_pct, round(100.0::DOUBLE * count(*) FILTER (tag = 'N') / count(*), 4) AS normal_pct FROM t GROUP BY 1""")
def outlier_counter(t):
    out = alerts.count_tags(tagged_events(t), ["event_type"])
    return out.select("event_type", "outlier_count", "unknown_count", "normal_count", "ambiguous_count", "total", r4("outlier_pct"), r4("normal_pct"))


SUPPLY = """WITH m AS (SELECT s_nationkey, avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier GROUP BY 1),
t AS (SELECT s_suppkey, s_nationkey, s_acctbal AS value, abs(s_acctbal - m) / nullif(s, 0) AS score, CASE WHEN s = 0 THEN 'I' WHEN abs(s_acctbal - m) / s > 1.5 THEN 'O' ELSE 'N' END AS tag FROM supplier JOIN m USING (s_nationkey)),
n AS (SELECT s_nationkey, coalesce(avg(value) FILTER (tag = 'O'), avg(value)) AS value, coalesce(avg(score) FILTER (tag = 'O'), avg(score)) AS score, CASE WHEN count(*) FILTER (tag = 'O') > 0 THEN 'O' ELSE 'N' END AS tag FROM t GROUP BY 1),
r AS (SELECT n_regionkey, coalesce(avg(value) FILTER (tag = 'O'), avg(value)) AS value, coalesce(avg(score) FILTER (tag = 'O'), avg(score)) AS score, CASE WHEN count(*) FILTER (tag = 'O') > 0 THEN 'O' ELSE 'N' END AS tag FROM n JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
"""


def supply(t):
    """Tagged supplier balances as a stream, and the hierarchy supplier, nation, region."""
    from quietsignal.operators import record

    found = record.detect(t("supplier"), "zscore", record.Settings(["s_nationkey"], ["s_acctbal"], threshold=1.5))
    rows = found.select(F.lit("supplier").alias("type"), F.col("s_suppkey").cast("string").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("s_acctbal").alias("value"), "score", "tag")
    up = t("supplier").select(F.lit("supplier").alias("type"), F.col("s_suppkey").cast("string").alias("id"), F.lit("nation").alias("parentType"), F.col("s_nationkey").cast("string").alias("parentId"), F.lit(False).alias("singleton"))
    top = t("nation").select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("string").alias("id"), F.lit("region").alias("parentType"), F.col("n_regionkey").cast("string").alias("parentId"), F.lit(False).alias("singleton"))
    return rows, up.unionByName(top)


@query("hierarchy_rollup", SUPPLY + "SELECT 'nation' AS type, s_nationkey::VARCHAR AS id, 0::BIGINT AS seq, round(value, 4) AS value, round(score, 4) AS score, tag FROM n")
def hierarchy_rollup(t):
    return alerts.roll_up(*supply(t)).select("type", "id", "seq", r4("value"), r4("score"), "tag")


@query("hierarchy_rollup_levels", SUPPLY + "SELECT 'nation' AS type, s_nationkey::VARCHAR AS id, round(value, 4) AS value, round(score, 4) AS score, tag FROM n UNION ALL SELECT 'region', n_regionkey::VARCHAR, round(value, 4), round(score, 4), tag FROM r")
def hierarchy_rollup_levels(t):
    return workflows.chain_roll_up(*supply(t), levels=2).select("type", "id", r4("value"), r4("score"), "tag")


SPLITS = [0.2, 0.4, 0.6, 0.8, 0.9, 0.95]
SIDES = TAGGED + f""", s AS (SELECT unnest({SPLITS}::DOUBLE[]) AS split),
c AS (SELECT split, count(*) FILTER (score < split)::DOUBLE AS n0, count(*) FILTER (score < split AND event_type = 'error')::DOUBLE AS p0, count(*) FILTER (score >= split)::DOUBLE AS n1, count(*) FILTER (score >= split AND event_type = 'error')::DOUBLE AS p1 FROM t, s GROUP BY 1),
q AS (SELECT split, n0, n1, p0 / nullif(n0, 0) AS a, p1 / nullif(n1, 0) AS b FROM c WHERE n0 > 0 AND n1 > 0)"""
_H = "(CASE WHEN {0} > 0 THEN -{0} * ln({0}) ELSE 0 END + CASE WHEN {0} < 1 THEN -(1 - {0}) * ln(1 - {0}) ELSE 0 END)"
ENTROPY = f"(n0 * {_H.format('a')} + n1 * {_H.format('b')}) / (n0 + n1)"


def stumps(t, criterion):
    return alerts.learn_threshold(tagged_events(t), [], F.col("event_type") == "error", SPLITS, criterion)


@query("threshold_learner_entropy", SIDES + f" SELECT split, round({ENTROPY}, 6) AS info FROM q")
def threshold_learner_entropy(t):
    return stumps(t, "entropy").select("split", round_to(F.col("info"), 6).alias("info"))


@query("threshold_learner_gini", SIDES + " SELECT split, round((n0 * 2 * a * (1 - a) + n1 * 2 * b * (1 - b)) / (n0 + n1), 6) AS info FROM q")
def threshold_learner_gini(t):
    return stumps(t, "gini").select("split", round_to(F.col("info"), 6).alias("info"))


@query("best_threshold", SIDES + f" SELECT split, round({ENTROPY}, 6) AS info FROM q ORDER BY {ENTROPY}, split LIMIT 1")
def best_threshold(t):
    out = workflows.feedback_threshold(tagged_events(t), [], F.col("event_type") == "error", SPLITS)
    return out.select("split", round_to(F.col("info"), 6).alias("info"))


@query("pseudo_relevance", TAGGED + """, r AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM t),
m3 AS (SELECT user_id, any_value(n) AS n, avg(score) FILTER (abs(k - least(greatest(floor(n * 0.05), 1), n)) <= 1) AS m FROM r GROUP BY 1)
SELECT user_id, round(CASE WHEN n > 60 THEN m WHEN user_id % 2 = 0 THEN 0.7 ELSE 0.8 END, 4) AS threshold FROM m3""")
def pseudo_relevance(t):
    old = t("events").select("user_id").distinct().where("user_id % 2 = 0").withColumn("threshold", F.lit(0.7))
    return alerts.pseudo_relevance(tagged_events(t), ["user_id"], "event_id", 5, True, 60, 0.8, old).select("user_id", r4("threshold"))


@query("precision_recall", TAGGED + """, d AS (SELECT event_id FROM t WHERE tag = 'O'), g AS (SELECT event_id FROM events WHERE value > 150),
c AS (SELECT count(*) FILTER (d.event_id IS NOT NULL AND g.event_id IS NOT NULL)::BIGINT AS tp, count(*) FILTER (g.event_id IS NULL)::BIGINT AS fp, count(*) FILTER (d.event_id IS NULL)::BIGINT AS fn FROM d FULL JOIN g USING (event_id))
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall FROM c""")
def precision_recall(t):
    out = alerts.precision_recall(tagged_events(t).where("tag = 'O'"), t("events").where("value > 150"), ["event_id"])
    return out.select("tp", "fp", "fn", r4("precision"), r4("recall"))


@query("score_tail", TAGGED + " SELECT event_type, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.95), 4) AS p95, round(quantile_cont(score, 0.99), 4) AS p99 FROM t GROUP BY 1")
def score_tail(t):
    return alerts.score_tail(tagged_events(t), ["event_type"], [0.9, 0.95, 0.99]).select("event_type", r4("p90"), r4("p95"), r4("p99"))


@query("retag_by_tail", TAGGED + ", q AS (SELECT event_type, quantile_cont(score, 0.99) AS q FROM t GROUP BY 1) SELECT event_id, CASE WHEN score > q THEN 'O' ELSE 'N' END AS tag FROM t JOIN q USING (event_type)")
def retag_by_tail(t):
    return workflows.retag_by_tail(tagged_events(t), ["event_type"], 0.99).select("event_id", "tag")


@query("tail_fit", """WITH s AS (SELECT event_type, value AS score FROM events), u AS (SELECT event_type, quantile_cont(score, 0.9) AS u, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT event_type, u, n, count(*)::BIGINT AS k, avg(score - u) AS m, var_pop(score - u) AS v FROM s JOIN u USING (event_type) WHERE score > u GROUP BY ALL),
g AS (SELECT *, 0.5 * (1 - m * m / v) AS a, 0.5 * m * (1 + m * m / v) AS b FROM f)
SELECT event_type, round(u, 4) AS u, k AS excesses, round(a, 4) AS shape, round(b, 4) AS scale, round(u + b / a * (pow(n * (1 - 0.999) / k, -a) - 1), 4) AS quantile FROM g""")
def tail_fit(t):
    out = alerts.tail_fit(t("events").withColumn("score", F.col("value")), ["event_type"], 0.9, 0.999)
    return out.select("event_type", r4("u"), "excesses", r4("shape"), r4("scale"), r4("quantile"))


GAPS = TAGGED + """, o AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM t WHERE tag = 'O'),
g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 43200 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS c FROM g)"""


@query("temporal_cluster", GAPS + """, k AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, c ORDER BY s, event_id) AS k, count(*) OVER (PARTITION BY user_id, c) AS n FROM c)
SELECT t.event_id, CASE WHEN k IS NULL THEN tag WHEN k = (n + 1) // 2 THEN 'O' ELSE 'N' END AS tag FROM t LEFT JOIN k USING (event_id)""")
def temporal_cluster(t):
    rows = tagged_events(t).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return alerts.cluster_alerts(rows, ["user_id"], "s", "event_id", max_gap=43_200).select("event_id", "tag")


@query("temporal_cluster_max", GAPS + """, k AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, c ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id, c) AS n FROM c)
SELECT t.event_id, CASE WHEN k IS NULL THEN tag WHEN n < 2 THEN 'N' WHEN k = 1 THEN 'O' ELSE 'N' END AS tag FROM t LEFT JOIN k USING (event_id)""")
def temporal_cluster_max(t):
    rows = tagged_events(t).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return alerts.cluster_alerts(rows, ["user_id"], "s", "event_id", max_gap=43_200, least=2, prototype="max", ignore_small=True).select("event_id", "tag")


@query("score_level_shift", TAGGED + """, w AS (SELECT *, row_number() OVER w AS i, avg(score) OVER (w ROWS 4 PRECEDING) AS a, avg(score) OVER (w ROWS 19 PRECEDING) AS b, stddev_pop(score) OVER (w ROWS 19 PRECEDING) AS s FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
z2 AS (SELECT *, CASE WHEN i >= 20 THEN (a - b) / nullif(s, 0) END AS zz FROM w),
f AS (SELECT *, max(CASE WHEN zz > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS f FROM z2)
SELECT event_id, round(zz, 4) AS shift, CASE WHEN f = 1 THEN 'O' WHEN i >= 20 THEN 'N' ELSE tag END AS tag FROM f""")
def score_level_shift(t):
    return alerts.score_level_shift(tagged_events(t), ["user_id"], "event_id", "event_id", 20, 5, 0.8).select("event_id", r4("shift"), "tag")


@query("level_shift_segments", """WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), b AS (SELECT e.*, CASE WHEN abs(value - m) > 20 THEN sign(value - m) ELSE 0 END AS s FROM events e JOIN m USING (user_id)),
w AS (SELECT *, row_number() OVER w AS i, lag(event_id, 4) OVER w AS first, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) AS up, sum(CASE WHEN s = -1 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) AS down FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, CASE WHEN i < 5 THEN 0 WHEN up >= 4 THEN 1 WHEN down >= 4 THEN -1 ELSE 0 END AS dir FROM w),
n AS (SELECT *, CASE WHEN dir <> coalesce(lag(dir) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN 1 ELSE 0 END AS new FROM d),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n)
SELECT user_id, dir::INTEGER AS dir, min(first)::BIGINT AS start, max(event_id)::BIGINT AS "end", count(*)::BIGINT AS rows FROM g WHERE dir <> 0 GROUP BY user_id, g, dir""")
def level_shift_segments(t):
    from quietsignal.operators import models

    means = models.moments(t("events"), ["user_id"], ["value"]).select("user_id", "value_mean")
    rows = models.attach(t("events"), means, ["user_id"]).withColumn("tag", F.expr("CASE WHEN abs(value - value_mean) > 20 THEN 'O' ELSE 'N' END")).drop("value_mean")
    return alerts.level_shifts(rows, ["user_id"], "value", means, "event_id", "event_id", 5, 1).select("user_id", "dir", "start", "end", "rows")


@query("calibration", TAGGED + " SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(score), 4) AS predicted, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0 END), 4) AS observed FROM t GROUP BY 1")
def calibration(t):
    return alerts.calibration(tagged_events(t), F.col("score"), (F.col("value") > 100).cast("int"), 10, []).select("bin", "n", r4("predicted"), r4("observed"))


@query("calibration_local", TAGGED + " SELECT event_type, least(floor(score * 5), 4)::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(score), 4) AS predicted, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0 END), 4) AS observed FROM t GROUP BY ALL")
def calibration_local(t):
    return alerts.calibration(tagged_events(t), F.col("score"), (F.col("value") > 100).cast("int"), 5, ["event_type"]).select("event_type", "bin", "n", r4("predicted"), r4("observed"))
