"""Sequence detectors over the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietsignal.functions.score import round_to, sequence
from quietsignal.operators import series
from quietsignal.plans.record_queries import r4
from quietsignal.plans.registry import query

STATES = ["click", "error", "purchase", "signup", "view"]
AT = ("event_id", "event_id")

TRANSITIONS = """WITH s AS (SELECT user_id, event_id, event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT prev, cur, count(*) + 1.0::DOUBLE AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL),
p AS (SELECT prev, cur, n / sum(n) OVER (PARTITION BY prev) AS p FROM c),
q AS (SELECT *, 1 - p AS miss, -p * ln(p) AS h, sum(-p * ln(p)) OVER (PARTITION BY prev) AS h_all, CASE WHEN row_number() OVER (PARTITION BY prev ORDER BY p DESC, cur) = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS not_best FROM p),
t AS (SELECT s.*, miss, h, h_all, not_best, -ln(p) AS neg FROM s LEFT JOIN q USING (prev, cur))"""
LAST4 = "OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)"


@query("markov_model", TRANSITIONS + " SELECT prev, cur, round(p, 6) AS prob FROM p")
def markov_model(t):
    return global_model(t).select("prev", "cur", round_to(F.col("prob"), 6).alias("prob"))


def global_model(t):
    """One model for all users, its transitions taken within each user's sequence."""
    rows = t("events").select("user_id", "event_id", "event_type")
    w = series.sequence(["user_id"], ["event_id"])
    steps = rows.withColumn("prev", F.lag("event_type").over(w)).where("prev IS NOT NULL").groupBy("prev", F.col("event_type").alias("cur")).agg(F.count("*").alias("n"))
    known = F.array(*[F.lit(s) for s in STATES])
    grid = rows.sparkSession.range(1).select(F.explode(known).alias("prev")).withColumn("cur", F.explode(known))
    full = grid.join(steps, ["prev", "cur"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1.0)
    total = full.groupBy("prev").agg(F.sum("n").alias("total"))
    return full.join(total, "prev").select(F.lit("all").alias("__all"), "prev", "cur", (F.col("n") / F.col("total")).alias("prob"))


def markov(t, strategy, threshold, cumulative=False):
    rows = t("events").select("user_id", "event_id", "event_type")
    out = series.markov(rows, global_model(t), ["user_id"], "event_type", *AT, 4, strategy, threshold, cumulative=cumulative, model_keys=[])
    return out.select("event_id", r4("score"), "tag")


def markov_sql(raw: str, threshold: float, full: str = "i >= 4") -> str:
    return TRANSITIONS + f""", r AS (SELECT event_id, user_id, CASE WHEN {full} THEN {raw} ELSE 0 END AS score FROM t)
SELECT event_id, round(score, 4) AS score, CASE WHEN max(CASE WHEN score > {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 1 THEN 'O' ELSE 'N' END AS tag FROM r"""


@query("markov_missprob", markov_sql(f"avg(miss) {LAST4}", 0.81))
def markov_missprob(t):
    return markov(t, "missProbability", 0.81)


@query("markov_missrate", markov_sql(f"avg(not_best) {LAST4}", 0.9))
def markov_missrate(t):
    return markov(t, "missRate", 0.9)


@query("markov_entropy", markov_sql(f"sum(h_all - h) {LAST4} / sum(h_all) {LAST4}", 0.805))
def markov_entropy(t):
    return markov(t, "entropyReduction", 0.805)


@query("markov_condprob", markov_sql(f"avg(neg) {LAST4}", 1.65))
def markov_condprob(t):
    return markov(t, "conditionalProbability", 1.65)


@query("markov_global", markov_sql("avg(neg) OVER (PARTITION BY user_id ORDER BY event_id)", 1.7, "i >= 2"))
def markov_global(t):
    return markov(t, "conditionalProbability", 1.7, cumulative=True)


@query("markov_by_key", """WITH s AS (SELECT user_id, event_id, event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
k AS (SELECT user_id, prev.prev, cur.cur FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type AS prev FROM events) prev, (SELECT DISTINCT event_type AS cur FROM events) cur),
c AS (SELECT user_id, k.prev, k.cur, coalesce(n, 0) + 1.0::DOUBLE AS n FROM k LEFT JOIN (SELECT user_id, prev, cur, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL) x USING (user_id, prev, cur))
SELECT user_id, prev, cur, round(n / sum(n) OVER (PARTITION BY user_id, prev), 6) AS prob FROM c""")
def markov_by_key(t):
    out = series.transition_model(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", *AT, STATES)
    return out.select("user_id", "prev", "cur", round_to(F.col("prob"), 6).alias("prob"))


@query("ngram_frequency", """WITH q AS (SELECT user_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events GROUP BY 1),
s AS (SELECT user_id, event_id, len(list_filter(e, lambda x: x < value)) AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events JOIN q USING (user_id)),
g AS (SELECT *, CASE WHEN i >= 2 THEN lag(y) OVER (PARTITION BY user_id ORDER BY event_id) || '_' || y END AS gram FROM s),
f0 AS (SELECT user_id, gram, count(*) AS c FROM g WHERE gram IS NOT NULL GROUP BY ALL),
f AS (SELECT user_id, gram, c / (max(c) OVER (PARTITION BY user_id))::DOUBLE AS f FROM f0),
w AS (SELECT a.user_id, a.event_id, b.gram, count(*) AS c FROM g a JOIN g b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 8 AND a.i WHERE a.i >= 10 GROUP BY ALL),
m AS (SELECT *, c / (max(c) OVER (PARTITION BY user_id, event_id))::DOUBLE AS fw FROM w),
dd AS (SELECT m.user_id, m.event_id, any_value(n.n2) + sum(fw * fw - 2 * fw * coalesce(f, 0)) AS d FROM m LEFT JOIN f USING (user_id, gram) JOIN (SELECT user_id, sum(f * f) AS n2 FROM f GROUP BY 1) n ON n.user_id = m.user_id GROUP BY m.user_id, m.event_id)
SELECT event_id, round(max(coalesce(d, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 4) AS score FROM events LEFT JOIN dd USING (user_id, event_id)""")
def ngram_frequency(t):
    rows = series.quantile_symbols(t("events").select("user_id", "event_id", "value"), ["user_id"], "value", 4)
    ref = series.ngram_frequencies(rows, ["user_id"], "symbol", *AT, 2)
    return series.ngram_distance(rows, ref, ["user_id"], "symbol", *AT, 2, 10).select("event_id", r4("score"))


_T = "[" + ", ".join(map(str, series.T95)) + "]"


@query("one_step_ahead", f"""WITH p AS (SELECT *, CASE WHEN row_number() OVER w > 5 THEN avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, p - value AS r, count(p) OVER w AS n, stddev_pop(p - value) OVER w AS s FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(p, 4) AS prediction, round(CASE WHEN n >= 5 THEN coalesce(1 - exp(-abs(r) / nullif(coalesce({_T}[n - 1], 1.96) * s * sqrt(1 + 1.0::DOUBLE / n), 0)), 0) ELSE 0 END, 4) AS score FROM r""")
def one_step_ahead(t):
    return series.one_step_ahead(t("events"), ["user_id"], "value", *AT, 5).select("event_id", r4("prediction"), r4("score"))


_SMOOTH = series.smoothing_weights(5, 0.3)


def _one_step_sql(a):
    return f"""p{a} AS (SELECT event_id, user_id, {a} AS x, CASE WHEN row_number() OVER w > 5 THEN {" + ".join(f"lag({a}, {i + 1}) OVER w * {v!r}::DOUBLE" for i, v in enumerate(_SMOOTH))} END AS p FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r{a} AS (SELECT *, p - x AS r, count(p - x) OVER w AS n, stddev_pop(p - x) OVER w AS s FROM p{a} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{a} AS (SELECT event_id, p, CASE WHEN x IS NOT NULL THEN CASE WHEN n >= 5 THEN coalesce(1 - exp(-abs(r) / nullif(coalesce({_T}[n - 1], 1.96) * s * sqrt(1 + 1.0::DOUBLE / n), 0)), 0) ELSE 0 END END AS score FROM r{a})"""


@query("one_step_ahead_all", f"""WITH g AS (SELECT event_id, user_id, value, (event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS gap FROM events), {_one_step_sql("value")}, {_one_step_sql("gap")}
SELECT event_id, round(v.p, 6) AS prediction_value, round(b.p, 6) AS prediction_gap, round((v.score * 2 + coalesce(b.score, 0)) / CASE WHEN b.score IS NULL THEN 2.0::DOUBLE ELSE 3 END, 4) AS score FROM svalue v JOIN sgap b USING (event_id)""")
def one_step_ahead_all(t):
    """Values and the gaps between a user's events, smoothed, values counting twice."""
    gap = F.col("event_id") - F.lag("event_id").over(sequence(["user_id"], ["event_id"]))
    rows = t("events").select("event_id", "user_id", "value", gap.cast("double").alias("gap"))
    out = series.one_step_ahead_all(rows, ["user_id"], {"value": 2.0, "gap": 1.0}, *AT, 5, weights=_SMOOTH)
    return out.select("event_id", *[round_to(F.col(c), 6).alias(c) for c in ("prediction_value", "prediction_gap")], r4("score"))


@query("residual_stats", """WITH p AS (SELECT *, CASE WHEN row_number() OVER w > 5 THEN avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(p)::BIGINT AS n, round(avg(value - p), 4) AS mean, round(stddev_pop(value - p), 4) AS sd FROM p GROUP BY 1""")
def residual_stats(t):
    out = series.one_step_ahead(t("events"), ["user_id"], "value", *AT, 5)
    return series.residual_stats(out, ["user_id"], "value").select("user_id", "n", r4("mean"), r4("sd"))


@query("discord", """WITH s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT a.user_id, a.i, list(b.v ORDER BY b.i) AS l FROM s a JOIN s b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 7 GROUP BY ALL HAVING count(*) = 8),
d AS (SELECT x.user_id, x.i, sqrt(min(list_sum(list_transform(list_zip(x.l, y.l), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 8) AS d FROM w x JOIN w y ON x.user_id = y.user_id AND abs(x.i - y.i) >= 8 GROUP BY ALL)
SELECT s.event_id, round(coalesce(max(d), 0), 4) AS score FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.i BETWEEN s.i - 7 AND s.i GROUP BY 1""")
def discord(t):
    return series.discord(t("events").select("user_id", "event_id", "value"), ["user_id"], "value", *AT, 8).select("event_id", r4("score"))


NEAR = "WITH l AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM events), g AS (SELECT event_id, len(l) AS n, list_sort(list_transform(l, lambda x: abs(x - value)))[2:5] AS g FROM l)"


@query("local_neighborhood_avg", NEAR + " SELECT event_id, round(CASE WHEN n = 5 THEN (g[1] + g[2]) / 2 ELSE 0 END, 6) AS score FROM g")
def local_neighborhood_avg(t):
    return series.local_neighborhood(t("events"), ["user_id"], "value", *AT, 5, nearest=2).select("event_id", round_to(F.col("score"), 6).alias("score"))


@query("local_neighborhood_count", NEAR + " SELECT event_id, CASE WHEN n = 5 THEN len(list_filter(g, lambda x: x <= 20.0)) ELSE 0 END::DOUBLE AS score FROM g")
def local_neighborhood_count(t):
    return series.local_neighborhood(t("events"), ["user_id"], "value", *AT, 5, distance=20.0).select("event_id", "score")


HALVES = """WITH w AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS b FROM events),
z AS (SELECT *, list_transform(list_sort(list_concat(a, b)), lambda v: len(list_filter(a, lambda y: y <= v)) / 10.0::DOUBLE - len(list_filter(b, lambda y: y <= v)) / 10.0::DOUBLE) AS g,
      list_transform(list_sort(list_concat(a, b))[1:19], lambda v, i: pow(len(list_filter(a, lambda y: y <= v)) * 20.0::DOUBLE - i * 10.0::DOUBLE, 2) / (i * (20 - i))) AS h FROM w WHERE len(a) = 10 AND len(b) = 10)"""


def changes(t, statistic, critical):
    return series.change_points(t("events"), ["user_id"], "value", *AT, 20, statistic, critical).select("user_id", "event_id", r4("stat"))


@query("change_point_ks", HALVES + " SELECT user_id, event_id, round(list_max(list_transform(g, lambda x: abs(x))), 4) AS stat FROM z WHERE list_max(list_transform(g, lambda x: abs(x))) >= 0.45")
def change_point_ks(t):
    return changes(t, "KS", 0.45)


@query("change_point_cvm", HALVES + " SELECT user_id, event_id, round(0.25 * list_sum(list_transform(g, lambda x: x * x)), 4) AS stat FROM z WHERE 0.25 * list_sum(list_transform(g, lambda x: x * x)) >= 0.3001")
def change_point_cvm(t):
    return changes(t, "CVM", 0.3001)


@query("change_point_ad", HALVES + " SELECT user_id, event_id, round(list_sum(h) / 100, 4) AS stat FROM z WHERE list_sum(h) / 100 >= 1.5001")
def change_point_ad(t):
    return changes(t, "AD", 1.5001)


@query("change_point_checkpoints", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, min(event_id)::BIGINT AS checkpoint FROM r WHERE k <= 19 GROUP BY 1")
def change_point_checkpoints(t):
    return series.checkpoints(t("events"), ["user_id"], *AT, 20)


@query("autocorr_lags", """WITH m AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT *, lag(d, 1) OVER w AS a, lag(d, 5) OVER w AS b, lag(d, 24) OVER w AS c FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, sum(d * d) AS v, sum(d * a) AS a, sum(d * b) AS b, sum(d * c) AS c FROM l GROUP BY 1)
SELECT user_id, 1 AS lag, round(a / v, 4) AS corr FROM s UNION ALL SELECT user_id, 5, round(b / v, 4) FROM s UNION ALL SELECT user_id, 24, round(c / v, 4) FROM s""")
def autocorr_lags(t):
    return series.autocorrelation(t("events"), ["user_id"], "value", *AT, [1, 5, 24]).select("user_id", "lag", r4("corr"))


@query("temporal_aggregate", "SELECT event_type, date_trunc('hour', ts)::VARCHAR AS bucket, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def temporal_aggregate(t):
    return series.temporal_aggregate(t("events"), ["event_type"], "ts", "value", "hour").select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), round_to(F.col("value"), 6).alias("value"))


@query("inter_event", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS interval FROM events")
def inter_event(t):
    return series.inter_event(t("events"), ["user_id"], "ts", "event_id").select("event_id", round_to(F.col("interval"), 6).alias("interval"))


@query("sequence_match", """WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS a FROM events GROUP BY 1), p AS (SELECT user_id, a[1:len(a) - 1] AS a, a[2:len(a)] AS b FROM s),
h AS (SELECT user_id, list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END) AS h FROM p)
SELECT user_id, list_sum(h)::DOUBLE AS matches, round(1 - list_sum(h) / len(h)::DOUBLE, 4) AS distance, list_max(list_transform(string_split(array_to_string(h, ''), '0'), lambda x: length(x)))::DOUBLE AS longest,
       list_sum(list_transform(string_split(array_to_string(h, ''), '0'), lambda x: length(x) * (length(x) + 1) / 2))::DOUBLE AS adjacency FROM h""")
def sequence_match(t):
    s = series.collected(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", *AT)
    a, b = F.slice("sequence", F.lit(1), F.size("sequence") - 1), F.slice("sequence", F.lit(2), F.size("sequence") - 1)
    return s.select("user_id", series.sequence_match(a, b).alias("matches"), round_to(series.sequence_match(a, b, distance=True)).alias("distance"), series.sequence_match(a, b, "longest").alias("longest"), series.sequence_match(a, b, "adjacency").alias("adjacency"))


@query("key_sequences", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS states FROM events GROUP BY 1")
def key_sequences(t):
    return series.collected(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", *AT).select("user_id", F.array_join("sequence", ",").alias("states"))
