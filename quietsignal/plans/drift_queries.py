"""Concept drift monitors; a user's events are a stream and ``error`` events are its errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quietsignal.functions.score import round_to
from quietsignal.operators import drift
from quietsignal.plans.record_queries import r4
from quietsignal.plans.registry import query

AT = ("event_id", "event_id")
E = "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS x, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
RUN = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


def errors(t):
    return t("events").select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("x"), F.col("event_type").isin("error", "view").cast("int").alias("y"))


DDM = E + f""", p AS (SELECT *, avg(x) {RUN} AS p FROM e), s AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p),
m AS (SELECT *, min(CASE WHEN n >= 10 THEN {{'ps': p + s, 'p': p, 's': s}} END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s),
ddm AS (SELECT user_id, event_id, p, s, CASE WHEN n > 10 AND p + s > low.p + 3 * low.s THEN 1 ELSE 0 END AS drift FROM m)"""


@query("ddm", DDM + " SELECT event_id, round(p, 4) AS p, round(s, 4) AS s, drift FROM ddm")
def ddm(t):
    return drift.ddm(errors(t), ["user_id"], "x", *AT, 10, 3.0).select("event_id", r4("p"), r4("s"), "drift")


@query("eddm", E + f""", a AS (SELECT *, max(CASE WHEN x = 1 THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
d AS (SELECT *, CASE WHEN x = 1 THEN (n - last)::DOUBLE END AS d FROM a), l AS (SELECT *, CASE WHEN d IS NOT NULL THEN avg(d) {RUN} + 2 * stddev_pop(d) {RUN} END AS level FROM d),
m AS (SELECT *, greatest(last_value(CASE WHEN n <= 20 THEN level END IGNORE NULLS) {RUN}, max(CASE WHEN n > 20 THEN level END) {RUN}) AS most FROM l),
f AS (SELECT *, CASE WHEN n > 20 AND level IS NOT NULL THEN CASE WHEN level / nullif(most, 0) < 0.9 THEN 1 ELSE 0 END END AS f FROM m)
SELECT event_id, round(level, 4) AS level, coalesce(last_value(f IGNORE NULLS) {RUN}, 0) AS drift FROM f""")
def eddm(t):
    return drift.eddm(errors(t), ["user_id"], "x", *AT, 20, 0.9).select("event_id", r4("level"), "drift")


@query("fhddm", E + """, a AS (SELECT *, CASE WHEN n >= 15 THEN 1 - avg(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS 14 PRECEDING) END AS a FROM e)
SELECT event_id, round(a, 4) AS accuracy, CASE WHEN max(a) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - a > sqrt(ln(2 / 0.1) / 30) THEN 1 ELSE 0 END AS drift FROM a""")
def fhddm(t):
    return drift.fhddm(errors(t), ["user_id"], "x", *AT, 15, 0.1).select("event_id", r4("accuracy"), "drift")


@query("lp_drift", E + f""", d AS (SELECT event_id, n, sum(CASE WHEN y = 1 AND x = 0 THEN 1 WHEN y = 0 AND x = 1 THEN -1 ELSE 0 END) {RUN} / n::DOUBLE AS d FROM e)
SELECT event_id, round(d, 4) AS difference, CASE WHEN n > 10 AND d > 0.25 THEN 1 ELSE 0 END AS drift FROM d""")
def lp_drift(t):
    return drift.paired_learners(errors(t), ["user_id"], "y", "x", *AT, 0.25, 10).select("event_id", r4("difference"), "drift")


ECDD = E + f""", z AS (SELECT *, pow(0.8, n) * sum(0.2 * x * pow(0.8, -n)) {RUN} AS z, avg(x) {RUN} AS p FROM e)"""
_ECDD = "CASE WHEN n > 10 AND z > p + 2 * sqrt(p * (1 - p) * 0.2 * (1 - pow(0.8, 2 * (n - 1))) / 1.8) THEN 1 ELSE 0 END"


@query("ecdd", ECDD + f" SELECT event_id, round(z, 4) AS z, {_ECDD} AS drift FROM z")
def ecdd(t):
    return drift.ecdd(errors(t), ["user_id"], "x", *AT, 0.2, 2.0, 10).select("event_id", r4("z"), "drift")


@query("drift_ensemble", DDM + f""", z AS (SELECT *, pow(0.8, n) * sum(0.2 * x * pow(0.8, -n)) {RUN} AS z, avg(x) {RUN} AS p FROM e), c AS (SELECT event_id, {_ECDD} AS c FROM z),
l AS (SELECT event_id, CASE WHEN n > 10 AND sum(CASE WHEN y = 1 AND x = 0 THEN 1 WHEN y = 0 AND x = 1 THEN -1 ELSE 0 END) {RUN} / n::DOUBLE > 0.25 THEN 1 ELSE 0 END AS l FROM e)
SELECT event_id, CASE WHEN drift + c + l > 0 THEN 1 ELSE 0 END AS any_drift, CASE WHEN drift + c + l = 3 THEN 1 ELSE 0 END AS all_drift, CASE WHEN drift + c + l >= 2 THEN 1 ELSE 0 END AS drift FROM ddm JOIN c USING (event_id) JOIN l USING (event_id)""")
def drift_ensemble(t):
    rows = drift.ddm(errors(t), ["user_id"], "x", *AT, 10, 3.0).withColumnRenamed("drift", "d1").drop("n", "p", "s")
    rows = drift.paired_learners(rows, ["user_id"], "y", "x", *AT, 0.25, 10).withColumnRenamed("drift", "d2").drop("n", "difference")
    rows = drift.ecdd(rows, ["user_id"], "x", *AT, 0.2, 2.0, 10).withColumnRenamed("drift", "d3")
    return drift.ensemble(rows, ["d1", "d2", "d3"], 2).select("event_id", "any_drift", "all_drift", "drift")


@query("drift_state", E + " SELECT user_id, count(*)::BIGINT AS n, round(avg(x), 4) AS p FROM e GROUP BY 1")
def drift_state(t):
    run = drift.ddm(errors(t), ["user_id"], "x", *AT, 10, 3.0)
    return drift.state(run, ["user_id"], ["n", "p"], *AT).select("user_id", F.col("n").cast("long").alias("n"), r4("p"))


@query("drift_resumed", E + f" SELECT event_id, n::BIGINT AS n, round(avg(x) {RUN}, 4) AS p FROM e QUALIFY n > 20")
def drift_resumed(t):
    """A stream cut after 20 rows and gone on with from the saved state, as if it had never been cut."""
    run = drift.ddm(errors(t), ["user_id"], "x", *AT, 10, 3.0)
    saved = drift.state(run.where("n <= 20"), ["user_id"], ["n", "p"], *AT)
    rest = run.where("n > 20").select("user_id", "event_id", "x")
    return drift.resume_rate(rest, saved, ["user_id"], "x", *AT).select("event_id", F.col("n").cast("long").alias("n"), round_to(F.col("p")).alias("p"))


@query("ddm_resumed", DDM + " SELECT event_id, drift FROM ddm QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20")
def ddm_resumed(t):
    """DDM cut after 20 rows and gone on with, minima and all."""
    rows = errors(t)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("__k", place)
    saved = drift.state(drift.ddm(rows.where("__k <= 20"), ["user_id"], "x", *AT, 10, 3.0, keep=True), ["user_id"], ["state"], *AT)
    return drift.ddm(rows.where("__k > 20").drop("__k"), ["user_id"], "x", *AT, 10, 3.0, saved=saved).select("event_id", "drift")
