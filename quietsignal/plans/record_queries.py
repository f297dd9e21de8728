"""Record detectors over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietsignal.functions.score import combine, exp_scale, round_to, tag
from quietsignal.functions.seasonal import season
from quietsignal.operators import alerts, models, record
from quietsignal.operators.record import Settings
from quietsignal.plans.registry import query

r4 = lambda c: round_to(F.col(c) if isinstance(c, str) else c).alias(c if isinstance(c, str) else "x")

Z = "WITH m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id), z AS (SELECT e.*, abs(value - m) / nullif(s, 0) AS z FROM events e JOIN m USING (user_id))"
TAGGED = Z + ", t AS (SELECT *, 1 - exp(-z) AS score, CASE WHEN z IS NULL THEN 'I' WHEN 1 - exp(-z) > 0.9 THEN 'O' ELSE 'N' END AS tag FROM z)"


def tagged_events(t, threshold: float = 0.9):
    """Events with exponentially scaled z-scores by user, tagged."""
    return record.detect(t("events"), "zscore", Settings(["user_id"], ["value"], exp_const=1.0, threshold=threshold))


@query("zscore_events", Z + """
SELECT user_id, count(*) FILTER (1 - exp(-z) > 0.95)::BIGINT AS outlier_count, count(*) FILTER (1 - exp(-z) <= 0.95)::BIGINT AS normal_count, count(*) FILTER (z IS NULL)::BIGINT AS unknown_count,
       count(*)::BIGINT AS total, round(100.0::DOUBLE * count(*) FILTER (1 - exp(-z) > 0.95) / count(*), 4) AS outlier_pct FROM z GROUP BY user_id""")
def zscore_events(t):
    out = alerts.count_tags(tagged_events(t, 0.95), ["user_id"])
    return out.select("user_id", "outlier_count", "normal_count", "unknown_count", "total", r4("outlier_pct"))


@query("zscore_seasonal", """
WITH e AS (SELECT *, hour(ts)::INTEGER AS h FROM events), m AS (SELECT user_id, h, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY ALL HAVING count(*) >= 3)
SELECT event_id, e.user_id, e.h AS season, round(abs(value - m) / nullif(s, 0), 4) AS score, CASE WHEN m IS NULL OR s = 0 THEN 'I' WHEN abs(value - m) / s > 1.4 THEN 'O' ELSE 'N' END AS tag
FROM e LEFT JOIN m USING (user_id, h)""")
def zscore_seasonal(t):
    rows = t("events").withColumn("season", season("hourOfDay", F.col("ts")))
    s = Settings(["user_id", "season"], ["value"], threshold=1.4)
    out = record.zscore(rows, models.moments(rows, s.keys, s.attrs, least=3), s).withColumn("tag", tag(F.col("score"), s.threshold))
    return out.select("event_id", "user_id", "season", r4("score"), "tag")


@query("zscore_weekend", """
WITH e AS (SELECT *, CASE WHEN isodow(ts) < 6 THEN 0 ELSE 1 END AS d, CASE WHEN hour(ts) >= 20 OR hour(ts) <= 7 THEN -1 ELSE hour(ts)::INTEGER END AS n FROM events)
SELECT d AS week_part, n AS day_part, event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM e GROUP BY ALL""")
def zscore_weekend(t):
    rows = t("events").withColumn("week_part", season("weekDayOrWeekendOfWeek", F.col("ts"))).withColumn("day_part", season("nightDayHourOfDay", F.col("ts")))
    m = models.moments(rows, ["week_part", "day_part", "event_type"], ["value"])
    return m.select("week_part", "day_part", "event_type", F.col("value_n").alias("n"), r4("value_mean").alias("mean"), r4("value_sd").alias("sd"))


@query("zscore_multi_weighted", """
WITH m AS (SELECT l_returnflag, avg(l_quantity) qm, stddev_pop(l_quantity) qs, avg(l_extendedprice) pm, stddev_pop(l_extendedprice) ps, avg(l_discount) dm, stddev_pop(l_discount) ds FROM lineitem GROUP BY 1),
z AS (SELECT l_suppkey, 0.5 * abs(l_quantity - qm) / qs + 0.3 * abs(l_extendedprice - pm) / ps + 0.2 * abs(l_discount - dm) / ds AS s FROM lineitem JOIN m USING (l_returnflag))
SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(s), 4) AS mean_score, round(max(s), 4) AS max_score FROM z GROUP BY 1""")
def zscore_multi_weighted(t):
    s = Settings(["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"], "weightedAverage", [0.5, 0.3, 0.2], few=True)
    rows = t("lineitem").select("l_suppkey", *s.keys, *s.attrs)
    out = record.zscore(rows, models.moments(rows, s.keys, s.attrs), s)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), round_to(F.avg("score")).alias("mean_score"), round_to(F.max("score")).alias("max_score"))


@query("score_combine_all", """
WITH a AS (SELECT o_orderkey, o_totalprice / 1000 AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 7)::DOUBLE END AS b, (o_custkey % 11)::DOUBLE AS c FROM orders)
SELECT o_orderkey, round((a + coalesce(b, 0) + c) / (2 + (b IS NOT NULL)::INT), 6) AS average, round((0.5 * a + coalesce(0.3 * b, 0) + 0.2 * c) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END), 6) AS weighted,
       round(CASE WHEN b IS NULL THEN (a + c) / 2 ELSE list_sort([a, b, c])[2] END, 6) AS median, round(greatest(a, b, c), 6) AS max, round(least(a, b, c), 6) AS min FROM a""")
def score_combine_all(t):
    one = [F.col("o_totalprice") / 1000, F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 7).cast("double")), (F.col("o_custkey") % 11).cast("double")]
    how = {"average": None, "weightedAverage": [0.5, 0.3, 0.2], "median": None, "max": None, "min": None}
    return t("orders").select("o_orderkey", *[round_to(combine(one, h, w), 6).alias("weighted" if w else h) for h, w in how.items()])


@query("robust_zscore", """
WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1), d AS (SELECT o_orderpriority, any_value(med) AS med, median(abs(o_totalprice - med)) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1)
SELECT o_orderkey, o_orderpriority, round(abs(o_totalprice - med) / nullif(mad, 0), 4) AS score, CASE WHEN abs(o_totalprice - med) / mad > 1.9 THEN 'O' ELSE 'N' END AS tag FROM orders JOIN d USING (o_orderpriority)""")
def robust_zscore(t):
    out = record.detect(t("orders"), "robustZscore", Settings(["o_orderpriority"], ["o_totalprice"], threshold=1.9, few=True))
    return out.select("o_orderkey", "o_orderpriority", r4("score"), "tag")


@query("extreme_value", Z + " SELECT event_id, user_id, round(exp(-exp(-z)), 4) AS score FROM z")
def extreme_value(t):
    out = record.detect(t("events"), "extremeValue", Settings(["user_id"], ["value"]))
    return out.select("event_id", "user_id", r4("score"))


BINS = "WITH b AS (SELECT *, floor(value / 25)::BIGINT AS b FROM events), h AS (SELECT event_type, b, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total FROM h)"


def binned(t):
    return {"b": models.bin_of(F.col("value"), 25)}, models.histogram(t("events"), ["event_type"], [models.bin_of(F.col("value"), 25)], ["b"])


@query("attr_probability_inverse", BINS + " SELECT event_id, event_type, round(1 - n / total::DOUBLE, 4) AS score FROM b JOIN k USING (event_type, b)")
def attr_probability_inverse(t):
    bins, h = binned(t)
    return record.bin_probability(t("events"), h, ["event_type"], bins).select("event_id", "event_type", r4("score"))


@query("attr_probability_log", BINS + " SELECT event_id, event_type, round(-ln(n / total::DOUBLE), 4) AS score FROM b JOIN k USING (event_type, b)")
def attr_probability_log(t):
    bins, h = binned(t)
    return record.bin_probability(t("events"), h, ["event_type"], bins, "log").select("event_id", "event_type", r4("score"))


@query("marginal_probability", """
WITH s AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY 1)
SELECT o_orderkey, round(0.6 * (1 - s.p) + 0.4 * (1 - q.p), 4) AS score FROM orders JOIN s USING (o_orderstatus) JOIN q USING (o_orderpriority)""")
def marginal_probability(t):
    bins = {"sb": F.col("o_orderstatus"), "pb": F.col("o_orderpriority")}
    h = models.histogram(t("orders"), [], list(bins.values()), list(bins))
    return record.marginal_probability(t("orders"), h, [], bins, [0.6, 0.4]).select("o_orderkey", r4("score"))


@query("cum_probability", BINS + ", c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) / total::DOUBLE AS f FROM k) SELECT event_id, event_type, round(greatest(f, 1 - f), 4) AS score FROM b JOIN c USING (event_type, b)")
def cum_probability(t):
    bins, h = binned(t)
    return record.cumulative_probability(t("events"), h, ["event_type"], "b", bins["b"]).select("event_id", "event_type", r4("score"))


@query("meta_probability", BINS + ", c AS (SELECT x.event_type, x.b, coalesce(sum(y.n), 0) / any_value(x.total)::DOUBLE AS q FROM k x LEFT JOIN k y ON x.event_type = y.event_type AND y.n < x.n GROUP BY ALL) SELECT event_id, event_type, round(1 - q, 4) AS score FROM b JOIN c USING (event_type, b)")
def meta_probability(t):
    bins, h = binned(t)
    return record.meta_probability(t("events"), h, ["event_type"], bins).select("event_id", "event_type", r4("score"))


@query("iqr_outlier", """
WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, greatest(a - l_extendedprice, l_extendedprice - b, 0) / nullif(b - a, 0) AS s FROM lineitem JOIN q USING (l_suppkey))
SELECT l_suppkey, count(*) FILTER (s > 0.4)::BIGINT AS outliers, count(*)::BIGINT AS n, round(max(s), 4) AS worst FROM s GROUP BY 1""")
def iqr_outlier(t):
    out = record.detect(t("lineitem").select("l_suppkey", "l_extendedprice"), "interPercentile", Settings(["l_suppkey"], ["l_extendedprice"], threshold=0.4))
    return out.groupBy("l_suppkey").agg(F.count_if(F.col("tag") == "O").alias("outliers"), F.count("*").alias("n"), round_to(F.max("score")).alias("worst"))


JOINT = "WITH b AS (SELECT *, floor(o_totalprice / 100000)::BIGINT AS p FROM orders), h AS (SELECT o_orderstatus, o_orderpriority, p, count(*)::DOUBLE AS n FROM b GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n * log2(n)) AS s FROM h)"


def joint(t):
    bins = {"b1": F.col("o_orderstatus"), "b2": F.col("o_orderpriority"), "b3": models.bin_of(F.col("o_totalprice"), 100_000)}
    return bins, models.histogram(t("orders"), [], list(bins.values()), list(bins))


@query("joint_probability", JOINT + " SELECT o_orderkey, round(1 - n / total, 4) AS score FROM b JOIN h USING (o_orderstatus, o_orderpriority, p), t")
def joint_probability(t):
    bins, h = joint(t)
    return record.bin_probability(t("orders"), h, [], bins).select("o_orderkey", r4("score"))


@query("entropy_increase", JOINT + """ SELECT o_orderkey, round(1000 * greatest((log2(total + 1) - (s + (n + 1) * log2(n + 1) - n * log2(n)) / (total + 1)) / (log2(total) - s / total) - 1, 0), 4) AS score_milli
FROM b JOIN h USING (o_orderstatus, o_orderpriority, p), t""")
def entropy_increase(t):
    bins, h = joint(t)
    return record.entropy_increase(t("orders"), h, [], bins).select("o_orderkey", round_to(F.col("score") * 1000).alias("score_milli"))


@query("mahalanobis_2d", """
WITH o AS (SELECT *, day(o_orderdate)::DOUBLE AS d FROM orders), m AS (SELECT o_orderpriority, avg(o_totalprice) AS mx, avg(d) AS my, var_pop(o_totalprice) AS a, covar_pop(o_totalprice, d) AS b, var_pop(d) AS c FROM o GROUP BY 1)
SELECT o_orderkey, round((c * (o_totalprice - mx) * (o_totalprice - mx) - 2 * b * (o_totalprice - mx) * (d - my) + a * (d - my) * (d - my)) / (a * c - b * b), 4) AS score FROM o JOIN m USING (o_orderpriority)""")
def mahalanobis_2d(t):
    rows = t("orders").withColumn("d", F.dayofmonth("o_orderdate").cast("double"))
    s = Settings(["o_orderpriority"], ["o_totalprice", "d"], few=True)
    return record.mahalanobis(rows, models.covariance(rows, s.keys, s.attrs), s).select("o_orderkey", r4("score"))


RANGE = "WITH q AS (SELECT user_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1)"


@query("out_of_range", RANGE + " SELECT event_id, round(1 / (1 + exp(-0.05 * CASE WHEN value > (lo + hi) / 2 THEN value - hi ELSE lo - value END)), 4) AS score FROM events JOIN q USING (user_id)")
def out_of_range(t):
    ranges = models.percentiles(t("events"), ["user_id"], ["value"], {"lo": 0.1, "hi": 0.9})
    return record.out_of_range(t("events"), ranges, Settings(["user_id"], ["value"]), 0.05).select("event_id", r4("score"))


@query("in_range_table", """WITH r AS (SELECT e.event_id, max(CASE WHEN e.value > (lo + hi) / 2 THEN 1 - 1 / (1 + exp(-4 * (e.value - hi))) ELSE 1 - 1 / (1 + exp(-4 * (lo - e.value))) END) AS s
  FROM events e JOIN (SELECT user_id, value - 1 AS lo, value + 1 AS hi FROM events WHERE event_id % 10 = 0) USING (user_id) GROUP BY 1)
SELECT event_id, round(coalesce(s, 0), 4) AS score FROM events LEFT JOIN r USING (event_id)""")
def in_range_table(t):
    """A table of ranges by user: one around each tenth of the user's values."""
    ranges = t("events").where("event_id % 10 = 0").select("user_id", (F.col("value") - 1).alias("value_lo"), (F.col("value") + 1).alias("value_hi"))
    return record.in_range(t("events"), ranges, Settings(["user_id"], ["value"]), 4.0).select("event_id", r4("score"))


@query("in_range", """SELECT event_id, round(greatest(1 - 1 / (1 + exp(-0.5 * CASE WHEN value > 15 THEN value - 20 ELSE 10 - value END)), 1 - 1 / (1 + exp(-0.5 * CASE WHEN value > 110 THEN value - 120 ELSE 100 - value END))), 4) AS score,
CASE WHEN greatest(1 - 1 / (1 + exp(-0.5 * CASE WHEN value > 15 THEN value - 20 ELSE 10 - value END)), 1 - 1 / (1 + exp(-0.5 * CASE WHEN value > 110 THEN value - 120 ELSE 100 - value END))) > 0.5 THEN 'O' ELSE 'N' END AS tag FROM events""")
def in_range(t):
    out = record.in_range(t("events"), [{"value": (10.0, 20.0)}, {"value": (100.0, 120.0)}], Settings([], ["value"]), 0.5)
    return out.withColumn("tag", tag(F.col("score"), 0.5)).select("event_id", r4("score"), "tag")


@query("threshold_keyed", TAGGED + " SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'A' WHEN score > 0.5 + (user_id % 5) / 10.0 THEN 'O' ELSE 'N' END AS tag FROM t")
def threshold_keyed(t):
    limits = t("events").select("user_id").distinct().where("user_id % 5 <> 0").withColumn("threshold", F.expr("0.5D + (user_id % 5) / 10.0D"))
    return record.keyed_threshold(tagged_events(t).drop("tag"), limits, ["user_id"]).select("event_id", "tag")


@query("threshold_both", TAGGED + " SELECT event_id, CASE WHEN score > 0.9 OR score < 0.05 THEN 'O' ELSE 'N' END AS tag FROM t")
def threshold_both(t):
    return tagged_events(t).withColumn("tag", tag(F.col("score"), 0.9, "both", 0.05)).select("event_id", "tag")


@query("clean_data", TAGGED + " SELECT event_id, user_id, event_type, round(value, 4) AS value FROM t WHERE tag <> 'O'")
def clean_data(t):
    return record.clean(tagged_events(t)).select("event_id", "user_id", "event_type", r4("value"))


@query("outliers_only", TAGGED + " SELECT event_id, round(score, 4) AS score, tag FROM t WHERE tag = 'O' AND score > 0.92")
def outliers_only(t):
    return record.above(record.outliers(tagged_events(t)), 0.92).select("event_id", r4("score"), "tag")


@query("clean_and_refit", TAGGED + """, m2 AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM t WHERE tag <> 'O' GROUP BY 1)
SELECT event_id, round(1 - exp(-abs(value - m2.m) / nullif(m2.s, 0)), 4) AS score FROM events JOIN m2 USING (user_id)""")
def clean_and_refit(t):
    from quietsignal.plans.workflows import clean_and_refit as workflow

    return workflow(t("events"), "zscore", Settings(["user_id"], ["value"], exp_const=1.0, threshold=0.9), 0.9).select("event_id", r4("score"))


@query("stats_by_key", "SELECT user_id, event_type, count(value)::BIGINT AS n, round(sum(value), 4) AS sum, round(sum(value * value), 4) AS sumsq, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS sd FROM events GROUP BY ALL HAVING count(*) >= 5")
def stats_by_key(t):
    m = models.moments(t("events"), ["user_id", "event_type"], ["value"], least=5)
    return m.select("user_id", "event_type", *[(F.col(f"value_{x}") if x == "n" else round_to(F.col(f"value_{x}"), 6 if x == "mean" else 4)).alias(x) for x in ("n", "sum", "sumsq", "mean", "sd")])


@query("medians_by_key", "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(any_value(m), 4) AS med, round(median(abs(value - m)), 4) AS mad FROM events JOIN m USING (user_id) GROUP BY 1")
def medians_by_key(t):
    return models.medians(t("events"), ["user_id"], ["value"]).select("user_id", r4("value_med").alias("med"), r4("value_mad").alias("mad"))


@query("multivariate_histogram", JOINT + " SELECT o_orderstatus AS b1, o_orderpriority AS b2, p AS b3, n::BIGINT AS n FROM h")
def multivariate_histogram(t):
    return joint(t)[1].select("b1", "b2", "b3", "n")


@query("rare_buckets", JOINT + " SELECT o_orderstatus AS b1, o_orderpriority AS b2, p AS b3, n::BIGINT AS n FROM h ORDER BY n, b1, b2, b3 LIMIT 10")
def rare_buckets(t):
    return joint(t)[1].select("b1", "b2", "b3", "n").orderBy("n", "b1", "b2", "b3").limit(10)


@query("unique_values", "SELECT event_type, hour(ts)::INTEGER AS season, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def unique_values(t):
    return t("events").groupBy("event_type", season("hourOfDay", F.col("ts")).alias("season")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query("discretised", "SELECT event_id, floor(value / 5)::BIGINT AS level FROM events")
def discretised(t):
    return t("events").select("event_id", models.bin_of(F.col("value"), 5).alias("level"))


@query("exp_scaled", Z + " SELECT user_id, round(avg(1 - exp(-0.5 * z)), 4) AS mean_scaled FROM z GROUP BY 1")
def exp_scaled(t):
    out = record.detect(t("events"), "zscore", Settings(["user_id"], ["value"]))
    return out.groupBy("user_id").agg(round_to(F.avg(exp_scale(0.5, F.col("score")))).alias("mean_scaled"))


BY_TYPE = Settings(["event_type"], ["value"], threshold=0.9, extra={"widths": {"value": 25}})
BY_ORDER = Settings([], ["o_orderstatus", "o_orderpriority", "o_totalprice"], threshold=0.9, extra={"widths": {"o_totalprice": 100_000}})
TAG9 = "CASE WHEN score > 0.9 THEN 'O' ELSE 'N' END AS tag"


def detected(name: str, strategy: str, sql: str, table: str, id_: str, s: Settings, scale: int = 1) -> None:
    """A query of ``record.detect`` for a strategy over a whole table; ``sql`` gives id and score."""

    def run(t):
        return record.detect(t(table), strategy, s).select(id_, round_to(F.col("score") * scale).alias("score"), "tag")

    query(name, f"SELECT {id_}, round({scale} * score, 4) AS score, {TAG9} FROM ({sql})")(run)


detected("detect_attribute", "attributeProbability", BINS + " SELECT event_id, 1 - n / total::DOUBLE AS score FROM b JOIN k USING (event_type, b)", "events", "event_id", BY_TYPE)
detected("detect_joint", "jointProbability", JOINT + " SELECT o_orderkey, 1 - n / total AS score FROM b JOIN h USING (o_orderstatus, o_orderpriority, p), t", "orders", "o_orderkey", BY_ORDER)
detected("detect_meta", "metaProbability", BINS + ", c AS (SELECT x.event_type, x.b, coalesce(sum(y.n), 0) / any_value(x.total)::DOUBLE AS q FROM k x LEFT JOIN k y ON x.event_type = y.event_type AND y.n < x.n GROUP BY ALL) SELECT event_id, 1 - q AS score FROM b JOIN c USING (event_type, b)", "events", "event_id", BY_TYPE)
detected("detect_cumulative", "cumulativeProbability", BINS + ", c AS (SELECT event_type, b, sum(n) OVER (PARTITION BY event_type ORDER BY b) / total::DOUBLE AS f FROM k) SELECT event_id, greatest(f, 1 - f) AS score FROM b JOIN c USING (event_type, b)", "events", "event_id", BY_TYPE)
detected("detect_entropy", "entropyIncrease", JOINT + " SELECT o_orderkey, greatest((log2(total + 1) - (s + (n + 1) * log2(n + 1) - n * log2(n)) / (total + 1)) / (log2(total) - s / total) - 1, 0) AS score FROM b JOIN h USING (o_orderstatus, o_orderpriority, p), t", "orders", "o_orderkey", BY_ORDER, 1000)
detected("detect_marginal", "marginalProbability", """WITH s AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY 1)
SELECT o_orderkey, 0.6 * (1 - s.p) + 0.4 * (1 - q.p) AS score FROM orders JOIN s USING (o_orderstatus) JOIN q USING (o_orderpriority)""", "orders", "o_orderkey", Settings([], ["o_orderstatus", "o_orderpriority"], weights=[0.6, 0.4], threshold=0.9))
