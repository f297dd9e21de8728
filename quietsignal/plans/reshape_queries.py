"""Reshaping, filtering, sorting and union of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietsignal.functions.score import round_to
from quietsignal.operators import reshape
from quietsignal.plans import sql
from quietsignal.plans.record_queries import Z
from quietsignal.plans.registry import query
from quietsignal.plans.series_queries import NEAR
from quietsignal.sources.files import union_tagged


@query("attribute_unpivot", "SELECT l_suppkey, attr, round(avg(value), 6) AS mean FROM (SELECT l_suppkey, unnest(['l_quantity', 'l_discount']) AS attr, unnest([l_quantity, l_discount]) AS value FROM lineitem) GROUP BY ALL")
def attribute_unpivot(t):
    return reshape.unpivot(t("lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"]).groupBy("l_suppkey", "attr").agg(round_to(F.avg("value"), 6).alias("mean"))


@query("split_expansion", "SELECT split, count(*)::BIGINT AS n, count(*) FILTER (value < split)::BIGINT AS below FROM events, (SELECT unnest([10.0, 50.0, 100.0]::DOUBLE[]) AS split) GROUP BY 1")
def split_expansion(t):
    rows = t("events").select("value", F.explode(F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0))).alias("split"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("split")).alias("below"))


@query("filter_expression", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '1%'")
def filter_expression(t):
    return reshape.selected(t("orders"), "o_totalprice > 200000 AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_orderstatus")


@query("numeric_sorter", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def numeric_sorter(t):
    return reshape.sorted_by(t("orders"), "o_totalprice", "o_orderkey", descending=True).select("o_orderkey", "o_totalprice")


@query("word_count", "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z]+'), lambda w: w <> '')) AS word FROM part) GROUP BY 1")
def word_count(t):
    return reshape.word_count(t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")), "text")


@query("tagged_union", "SELECT src, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys FROM (SELECT 0 AS src, c_nationkey AS k FROM customer UNION ALL SELECT 1, s_nationkey FROM supplier) GROUP BY 1")
def tagged_union(t):
    both = union_tagged(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))
    return both.groupBy("src").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("since_checkpoint", "SELECT event_id, user_id FROM events WHERE user_id % 2 = 1 OR event_id >= (SELECT max(event_id) // 2 FROM events)")
def since_checkpoint(t):
    half = t("events").agg(F.floor(F.max("event_id") / 2).alias("checkpoint"))
    marks = t("events").select("user_id").distinct().where("user_id % 2 = 0").join(F.broadcast(half))  # one row
    return reshape.since(t("events"), marks, ["user_id"], "event_id").select("event_id", "user_id")


@query("sql_scores", Z + " SELECT event_id, round(1 - exp(-z), 4) AS score, CASE WHEN 1 - exp(-z) > 0.9 THEN 'O' ELSE 'N' END AS tag FROM z")
def sql_scores(t):
    """The scalar functions as a SQL user calls them."""
    events = t("events")
    sql.register(events.sparkSession)
    scored = "WITH m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM {events} GROUP BY user_id), z AS (SELECT event_id, exp_scale(1D, zscore(value, m, s)) AS score FROM {events} JOIN m USING (user_id)) SELECT event_id, round(score, 4) AS score, outlier_tag(score, 0.9D) AS tag FROM z"
    return events.sparkSession.sql(scored, events=events)


@query("sql_neighborhood", NEAR + " SELECT event_id AS seq, round((g[1] + g[2]) / 2, 6) AS score FROM g WHERE n = 5")
def sql_neighborhood(t):
    """The table function over a table partitioned by user."""
    events = t("events")
    sql.register(events.sparkSession)
    events.createOrReplaceTempView("quietsignal_events")
    return events.sparkSession.sql("SELECT seq, round(score, 6) AS score FROM neighborhood_score(TABLE(SELECT user_id, event_id AS seq, value FROM quietsignal_events) PARTITION BY user_id ORDER BY seq)")


@query("windowed_stats", "SELECT event_type, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, count(value)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_stats(t):
    """Time windows with a watermark, as on a stream."""
    from quietsignal.streaming.scorers import windowed_stats as stats

    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stats(rows, ["event_type"], "ts", "value", "6 hours", None, "1 hour")
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", round_to(F.col("mean"), 6).alias("mean"))
