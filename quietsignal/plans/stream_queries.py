"""Streams over the tables, forecasts with feedback, exploration and generated data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quietsignal.functions.score import round_to
from quietsignal.functions import normal
from quietsignal.operators import explore, forecast, models, record, series
from quietsignal.operators.record import Settings
from quietsignal.plans.record_queries import BY_ORDER, BY_TYPE, TAGGED, r4
from quietsignal.plans.registry import ORACLES, query
from quietsignal.plans.series_queries import LAST4, TRANSITIONS, global_model
from quietsignal.sources import generators
from quietsignal.streaming import scorers

AT = ("event_id", "event_id")


def stream_of(t, table: str):
    """A table's files as a stream; the folder above a table of one file is searched by name."""
    static = t(table)
    spark, path = static.sparkSession, static.inputFiles()[0]
    folder, _, name = path.rpartition("/")
    glob = name if folder.rpartition("/")[2] != f"{table}.parquet" else "*.parquet"
    return spark, scorers.read_files(spark, folder, static.schema, glob)


def finished(spark: SparkSession, stream):
    """Run a stream to its end into the session's shared folder and read the result back."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    base = base or tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    scorers.run_to_folder(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_zscore", TAGGED + " SELECT event_id, round(score, 4) AS score, tag FROM t")
def stream_zscore(t):
    s = Settings(["user_id"], ["value"], exp_const=1.0, threshold=0.9)
    spark, stream = stream_of(t, "events")
    model = models.moments(t("events"), s.keys, s.attrs)
    return finished(spark, scorers.score(stream, model, "zscore", s).select("event_id", "score", "tag")).select("event_id", r4("score"), "tag")


@query("stream_markov", TRANSITIONS + f" SELECT user_id, event_id, round(CASE WHEN i >= 4 THEN avg(neg) {LAST4} ELSE 0 END, 4) AS score FROM t")
def stream_markov(t):
    spark, stream = stream_of(t, "events")
    p = {(r["prev"], r["cur"]): r["prob"] for r in global_model(t).collect()}  # a transition matrix of a few states
    return finished(spark, scorers.markov(stream, "user_id", "event_type", "event_id", p, 4, 1.65)).select("user_id", "event_id", r4("score"))


def streamed_markov(name: str, strategy: str, raw: str) -> None:
    def run(t):
        spark, stream = stream_of(t, "events")
        p = {(r["prev"], r["cur"]): r["prob"] for r in global_model(t).collect()}
        return finished(spark, scorers.markov(stream, "user_id", "event_type", "event_id", p, 4, 1.65, strategy=strategy)).select("user_id", "event_id", r4("score"))

    query(name, TRANSITIONS + f" SELECT user_id, event_id, round(CASE WHEN i >= 4 THEN {raw} ELSE 0 END, 4) AS score FROM t")(run)


streamed_markov("stream_markov_missprob", "missProbability", f"avg(miss) {LAST4}")
streamed_markov("stream_markov_missrate", "missRate", f"avg(not_best) {LAST4}")
streamed_markov("stream_markov_entropy", "entropyReduction", f"sum(h_all - h) {LAST4} / sum(h_all) {LAST4}")


def streamed(name: str, strategy: str, s: Settings, table: str, id_: str, sql: str, scale: int = 1) -> None:
    """A stream scored by a model of the whole table, through the same dispatcher as batches."""

    def run(t):
        spark, stream = stream_of(t, table)
        out = scorers.score(stream, record.fit(t(table), strategy, s), strategy, s).select(id_, "score", "tag")
        return finished(spark, out).select(id_, round_to(F.col("score") * scale).alias("score"), "tag")

    query(name, sql)(run)


streamed("stream_attribute", "attributeProbability", BY_TYPE, "events", "event_id", ORACLES["detect_attribute"])
streamed("stream_meta", "metaProbability", BY_TYPE, "events", "event_id", ORACLES["detect_meta"])
streamed("stream_entropy", "entropyIncrease", BY_ORDER, "orders", "o_orderkey", ORACLES["detect_entropy"], 1000)


@query("stream_alerts", TAGGED + " SELECT event_id, user_id FROM t WHERE score > 0.95")
def stream_alerts(t):
    s = Settings(["user_id"], ["value"], exp_const=1.0, threshold=0.9)
    spark, stream = stream_of(t, "events")
    found = scorers.alerts(scorers.score(stream, models.moments(t("events"), s.keys, s.attrs), "zscore", s), 0.95)
    return finished(spark, found.select("event_id", "user_id"))


_T95 = "[" + ", ".join(map(str, series.T95)) + "]"


@query("one_step_replacing", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s(user_id, i, event_id, l, n, t, q, p, score) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], 0::BIGINT, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE, 0::DOUBLE FROM events UNION ALL
  SELECT user_id, i, event_id, list_append(CASE WHEN len(l) = 5 THEN l[2:5] ELSE l END, CASE WHEN score > 0.95 THEN p ELSE value END),
    n + CASE WHEN p IS NOT NULL AND score <= 0.95 THEN 1 ELSE 0 END, t + CASE WHEN p IS NOT NULL AND score <= 0.95 THEN p - value ELSE 0 END, q + CASE WHEN p IS NOT NULL AND score <= 0.95 THEN (p - value) * (p - value) ELSE 0 END, p, score
  FROM (SELECT *, CASE WHEN n >= 5 AND w > 0 THEN 1 - exp(-abs(p - value) / w) ELSE 0 END AS score
    FROM (SELECT s.user_id, e.i, e.event_id, e.value, l, n, t, q, CASE WHEN len(l) = 5 THEN list_avg(l) END AS p,
      coalesce({_T95}[n - 1], 1.96) * sqrt(greatest(q / greatest(n, 1) - (t / greatest(n, 1)) * (t / greatest(n, 1)), 0)) * sqrt(1 + 1 / greatest(n, 1)::DOUBLE) AS w FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))
SELECT event_id, round(p, 4) AS prediction, round(score, 4) AS score FROM s WHERE i > 0""")
def one_step_replacing(t):
    """Predictions take outliers' places in the window, so each row depends on the decisions before it."""
    out = forecast.replacing(t("events").select("user_id", "event_id", "value"), ["user_id"], "value", *AT, 5, 0.95)
    return out.select("event_id", r4("prediction"), r4("score"))


def _horner(coefficients, x):
    out = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _ratio_sql(pair, x):
    return f"{_horner(pair[0], x)} / {_horner(pair[1], x)}"


@query("shapiro_wilk", f"""WITH r AS (SELECT user_id, value AS x, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
u AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p, p - 0.5::DOUBLE AS q, 0.180625::DOUBLE - q * q AS k, sqrt(-ln(least(p, 1 - p))) - 1.6::DOUBLE AS t FROM r),
m AS (SELECT *, CASE WHEN abs(q) <= 0.425::DOUBLE THEN q * {_ratio_sql(normal.CENTRE, "k")} ELSE sign(q) * {_ratio_sql(normal.TAIL, "t")} END AS m FROM u),
s AS (SELECT user_id, any_value(n)::BIGINT AS n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(any_value(n)::DOUBLE) AS h, var_pop(x) * count(*) AS ss FROM m GROUP BY 1 HAVING count(*) > 5),
a AS (SELECT *, m1 / sqrt(mm) + {_horner([0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], "h")} AS a1, m2 / sqrt(mm) + {_horner([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], "h")} AS a2,
sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS f FROM s),
w AS (SELECT a.user_id, any_value(a.n) AS n, pow(sum(m.x * CASE WHEN i = a.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = a.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / f END), 2) / any_value(ss) AS w FROM a JOIN m ON m.user_id = a.user_id GROUP BY 1),
l AS (SELECT *, ln(n::DOUBLE) AS g, (ln(1 - w) - {_horner([-1.5861, -0.31082, -0.083751, 0.0038915], "g")}) / exp({_horner([-0.4803, -0.082676, 0.0030302], "g")}) AS z FROM w WHERE n > 11),
e AS (SELECT *, 1 / (1 + abs(z) / sqrt(2.0::DOUBLE) / 2) AS t, t * exp(-z * z / 2 + {_horner(normal.ERFC, "t")}) / 2 AS half FROM l)
SELECT user_id, n, round(w, 6) AS w, round(CASE WHEN z >= 0 THEN half ELSE 1 - half END, 4) AS p FROM e""")
def shapiro_wilk(t):
    """Users with more than 11 events."""
    out = explore.shapiro_wilk(t("events"), ["user_id"], "value").where("n > 11")
    return out.select("user_id", "n", round_to(F.col("w"), 6).alias("w"), r4("p"))


@query("normality", """WITH m AS (SELECT event_type, count(*)::BIGINT AS n, avg(value) AS m FROM events GROUP BY 1),
s AS (SELECT event_type, any_value(n) AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS s, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS k FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, round(s, 4) AS skewness, round(k, 4) AS kurtosis, round(n / 6.0::DOUBLE * (s * s + k * k / 4), 2) AS jarque_bera FROM s""")
def normality(t):
    return explore.normality(t("events"), ["event_type"], "value").select("event_type", "n", r4("skewness"), r4("kurtosis"), round_to(F.col("jarque_bera"), 2).alias("jarque_bera"))


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS corr FROM lineitem GROUP BY 1")
def correlation(t):
    return explore.correlation(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", r4("corr"))


@query("partial_autocorr", """WITH m AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT *, lag(d, 1) OVER w AS a, lag(d, 2) OVER w AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, sum(d * a) / sum(d * d) AS a, sum(d * b) / sum(d * d) AS b FROM l GROUP BY 1)
SELECT user_id, 1 AS lag, round(a, 4) AS pacf FROM s UNION ALL SELECT user_id, 2, round((b - a * a) / (1 - a * a), 4) FROM s""")
def partial_autocorr(t):
    return explore.partial_autocorrelation(series.autocorrelation(t("events"), ["user_id"], "value", *AT, [1, 2]), ["user_id"]).select("user_id", "lag", r4("pacf"))


@query("decomposition", """WITH t AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, CASE WHEN count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, avg(value - trend) OVER (PARTITION BY user_id, i % 7) AS seasonal FROM t) SELECT event_id, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS rest FROM s""")
def decomposition(t):
    return explore.decompose(t("events"), ["user_id"], "value", *AT, 7).select("event_id", *[round_to(F.col(c), 6).alias(c) for c in ("trend", "seasonal", "rest")])


@query("cycle_length", """WITH m AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT *, lag(d, 3) OVER w AS a, lag(d, 5) OVER w AS b, lag(d, 7) OVER w AS c FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, sum(d * a) AS a, sum(d * b) AS b, sum(d * c) AS c FROM l GROUP BY 1) SELECT user_id, CASE WHEN a >= greatest(b, c) THEN 3 WHEN b >= c THEN 5 ELSE 7 END AS cycle FROM s""")
def cycle_length(t):
    return series.cycle_length(series.autocorrelation(t("events"), ["user_id"], "value", *AT, [3, 5, 7]), ["user_id"])


@query("generated_cpu_usage")
def generated_cpu_usage(t):
    """Planted CPU readings, found by weekday-aware z-scores; a row for each server."""
    rows = generators.cpu_usage(t("region").sparkSession).withColumn("weekend", (F.col("day") >= 5).cast("int"))
    out = record.detect(rows, "robustZscore", Settings(["server", "weekend"], ["usage"], threshold=3.0))
    return out.groupBy("server").agg(F.count("*").alias("n"), F.count_if("planted").alias("planted"), F.count_if(F.col("planted") & (F.col("tag") == "O")).alias("found"))
