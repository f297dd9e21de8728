"""Neighbours, clusters, forests, components and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietsignal.functions.score import round_to, tag
from quietsignal.operators import density, forest, models, projection, similarity
from quietsignal.plans.record_queries import r4
from quietsignal.plans.registry import query

PAIRS = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)"""
KNN = PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM p), n AS (SELECT * FROM r WHERE k <= 3)"


def neighbours(t, k=3):
    return density.nearest(t("embeddings"), ["label"], "vec_id", "embedding", k)


@query("knn_topk", KNN + " SELECT label, i AS source, j AS target, k::INTEGER AS rank, round(d, 4) AS dist FROM n")
def knn_topk(t):
    return neighbours(t).select("label", "source", "target", "rank", r4("dist"))


@query("lof", KNN + """, kd AS (SELECT i, max(d) AS kd FROM n GROUP BY 1), lrd AS (SELECT n.i, 1 / avg(greatest(d, kd)) AS lrd FROM n JOIN kd ON kd.i = n.j GROUP BY 1)
SELECT n.i AS source, round(avg(b.lrd) / any_value(a.lrd), 4) AS lof, CASE WHEN avg(b.lrd) / any_value(a.lrd) > 1.05 THEN 'O' ELSE 'N' END AS tag FROM n JOIN lrd a ON a.i = n.i JOIN lrd b ON b.i = n.j GROUP BY 1""")
def lof(t):
    return density.lof(neighbours(t)).withColumn("tag", tag(F.col("lof"), 1.05)).select("source", r4("lof"), "tag")


@query("lof_keyed", """WITH v AS (SELECT label % 3 AS k, vec_id % 50 AS id, min(vec_id) AS vec_id FROM embeddings GROUP BY ALL), e AS (SELECT k, id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM v JOIN embeddings USING (vec_id)),
p AS (SELECT a.k, a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a JOIN e b ON a.k = b.k AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY d, j) AS n FROM p), n AS (SELECT * FROM r WHERE n <= 5),
kd AS (SELECT k, i, max(d) AS kd FROM n GROUP BY ALL), lrd AS (SELECT n.k, n.i, 1 / avg(greatest(d, kd)) AS lrd FROM n JOIN kd ON kd.i = n.j AND kd.k = n.k GROUP BY ALL)
SELECT n.k, n.i AS source, round(avg(b.lrd) / any_value(a.lrd), 4) AS lof FROM n JOIN lrd a ON a.i = n.i AND a.k = n.k JOIN lrd b ON b.i = n.j AND b.k = n.k GROUP BY ALL""")
def lof_keyed(t):
    """Ids that repeat over keys: a row for each key and id."""
    first = t("embeddings").groupBy((F.col("label") % 3).alias("k"), (F.col("vec_id") % 50).alias("id")).agg(F.min(F.struct("vec_id", "embedding")).alias("s"))
    return density.lof(density.nearest(first.select("k", "id", F.col("s.embedding").alias("v")), ["k"], "id", "v", 5)).select("k", "source", r4("lof"))


@query("lof_records", KNN + """, kd AS (SELECT i, max(d) AS kd FROM n GROUP BY 1), lrd AS (SELECT n.i, 1 / avg(greatest(d, kd)) AS lrd FROM n JOIN kd ON kd.i = n.j GROUP BY 1),
l AS (SELECT n.i, avg(b.lrd) / any_value(a.lrd) AS lof FROM n JOIN lrd a ON a.i = n.i JOIN lrd b ON b.i = n.j GROUP BY 1)
SELECT vec_id, label, len(embedding)::INTEGER AS width, round(lof, 4) AS score FROM embeddings JOIN l ON l.i = vec_id""")
def lof_records(t):
    found = density.lof(neighbours(t)).select(F.col("source").alias("vec_id"), "lof")
    return t("embeddings").join(found, "vec_id").select("vec_id", "label", F.size("embedding").alias("width"), round_to(F.col("lof")).alias("score"))


SCALED = PAIRS + ", s AS (SELECT label, i, j, floor(d * 1000)::BIGINT AS d FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM s), a AS (SELECT i, (sum(d) // count(*))::BIGINT AS a FROM k WHERE k <= 10 GROUP BY 1), q AS (SELECT i, a, (1000000 // greatest(a, 1))::BIGINT AS q FROM a)"


def scaled(t):
    """What rests on ten neighbours takes these, not all pairs."""
    return density.nearest(t("embeddings"), ["label"], "vec_id", "embedding", 10, scale=1000)


@query("average_distance", SCALED + " SELECT i AS source, a AS avg_dist, q AS density FROM q")
def average_distance(t):
    return density.density(density.average_distance(scaled(t), ["label"])).select("source", "avg_dist", "density")


@query("neighbour_groups", SCALED + " SELECT i AS leader, j AS member, k::INTEGER AS place FROM k WHERE k <= 10 UNION ALL SELECT DISTINCT i, i, 0 FROM k")
def neighbour_groups(t):
    return density.neighbour_groups(scaled(t), ["label"]).select("leader", "member", "place")


@query("relative_density", SCALED + """, g AS (SELECT i AS leader, j AS member FROM k WHERE k <= 10 UNION ALL SELECT DISTINCT i, i FROM k)
SELECT leader, (max(q) FILTER (leader = member) * 1000 // sum(q))::BIGINT AS relative FROM g JOIN q ON q.i = member GROUP BY 1""")
def relative_density(t):
    pairs = scaled(t)
    return density.relative_density(density.neighbour_groups(pairs, ["label"]), density.density(density.average_distance(pairs, ["label"]))).select("leader", "relative")


@query("pairwise_distance", PAIRS + " SELECT label, count(*)::BIGINT AS pairs, round(avg(d), 4) AS mean_dist, round(min(d), 4) AS least FROM p GROUP BY 1")
def pairwise_distance(t):
    out = density.pair_summary(t("embeddings"), ["label"], "vec_id", "embedding")
    return out.select("label", "pairs", round_to(F.col("mean_dist")).alias("mean_dist"), round_to(F.col("least")).alias("least"))


MIXED = """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) - min(c_acctbal) AS span FROM customer),
d AS (SELECT a.c_custkey AS source, b.c_custkey AS target, floor((abs(a.c_acctbal - b.c_acctbal) / span * 2 + CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 0.0::DOUBLE ELSE 1 END + CASE WHEN a.c_nationkey = b.c_nationkey THEN 0.0::DOUBLE ELSE 1 END) / 4 * 1000)::BIGINT AS dist FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey, s)"""


@query("mixed_similarity", MIXED + " SELECT source, target, dist FROM d WHERE dist <= 20")
def mixed_similarity(t):
    """Customers alike in balance, segment and nation together."""
    return similarity.mixed_pairs(t("customer"), "c_custkey", {"c_acctbal": 2.0}, {"c_mktsegment": 1.0, "c_nationkey": 1.0}, 20)


@query("mixed_similarity_degrees", MIXED + ", n AS (SELECT source AS c_custkey FROM d WHERE dist <= 260 UNION ALL SELECT target FROM d WHERE dist <= 260) SELECT c_custkey, count(*)::BIGINT AS n FROM n GROUP BY 1")
def mixed_similarity_degrees(t):
    """How many others each customer is like, where one of segment and nation may differ."""
    return similarity.mixed_degrees(t("customer"), "c_custkey", {"c_acctbal": 2.0}, {"c_mktsegment": 1.0, "c_nationkey": 1.0}, 260)


NN9 = PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM p), n AS (SELECT * FROM r WHERE k <= 9), h AS (SELECT vec_id, vec_id >= (SELECT count(*) FROM embeddings) // 2 AS late FROM embeddings)"


def halves(t):
    n = t("embeddings").count()
    return t("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") >= n // 2).alias("late"))


@query("nn_drift", NN9 + ", c AS (SELECT n.i, count(*) FILTER (a.late <> b.late) AS o FROM n JOIN h a ON a.vec_id = n.i JOIN h b ON b.vec_id = n.j GROUP BY 1) SELECT i AS source, round(o / greatest(9 - o, 1)::DOUBLE - 1, 4) AS drift FROM c ORDER BY abs(o / greatest(9 - o, 1)::DOUBLE - 1) DESC, i LIMIT 50")
def nn_drift(t):
    return density.neighbour_drift(neighbours(t, 9), halves(t), 50).select("source", r4("drift"))


@query("nn_classifier_drift", NN9 + ", c AS (SELECT n.i, avg(CASE WHEN late THEN 1.0::DOUBLE ELSE 0 END) AS p FROM n JOIN h ON h.vec_id = n.j GROUP BY 1) SELECT round(avg(greatest(p, 1 - p)), 4) AS certainty FROM c")
def nn_classifier_drift(t):
    return density.classifier_drift(neighbours(t, 9), halves(t)).select(r4("certainty"))


CENTERS = [{"id": 0, "size": 700, "center": [50.0, 5.0]}, {"id": 1, "size": 250, "center": [150.0, 15.0]}, {"id": 2, "size": 50, "center": [300.0, 25.0]}]


@query("cblof", """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS p, day(o_orderdate)::DOUBLE AS d FROM orders),
x AS (SELECT o_orderkey, sqrt((p - 50) * (p - 50) + (d - 5) * (d - 5)) AS a, sqrt((p - 150) * (p - 150) + (d - 15) * (d - 15)) AS b, sqrt((p - 300) * (p - 300) + (d - 25) * (d - 25)) AS c FROM o)
SELECT o_orderkey, CASE WHEN a <= least(b, c) THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster, round(least(a, b), 6) AS score, CASE WHEN least(a, b) > 60 THEN 'O' ELSE 'N' END AS tag FROM x""")
def cblof(t):
    rows = t("orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("p"), F.dayofmonth("o_orderdate").alias("d"))
    out = density.cluster_distance(rows, ["p", "d"], density.large_clusters(CENTERS)).withColumn("tag", tag(F.col("score"), 60.0))
    return out.select("o_orderkey", "cluster", round_to(F.col("score"), 6).alias("score"), "tag")


@query("pca_reconstruction", """WITH e AS (SELECT event_id, event_type, value, hour(ts)::DOUBLE * 4 AS h FROM events), m AS (SELECT event_type, avg(value) AS mx, avg(h) AS my, var_pop(value) AS a, covar_pop(value, h) AS b, var_pop(h) AS c FROM e GROUP BY 1),
l AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM m),
d AS (SELECT event_id, value - mx AS x, h - my AS y, a, b, c, l1, l2 FROM e JOIN l USING (event_type))
SELECT event_id, round(sqrt(greatest(x * x + y * y - (a * x * x + 2 * b * x * y + c * y * y - l2 * (x * x + y * y)) / (l1 - l2), 0)), 4) AS score FROM d""")
def pca_reconstruction(t):
    rows = t("events").select("event_id", "event_type", "value", (F.hour("ts") * 4.0).alias("h"))
    model = projection.fit_components(rows, ["event_type"], ["value", "h"], 1)
    return projection.reconstruction_error(rows, model, ["event_type"], ["value", "h"], 1).select("event_id", r4("score"))


TREES, DEPTH, SAMPLE = 16, 6, 250


def orders(t):
    return t("orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("p"), F.dayofmonth("o_orderdate").cast("double").alias("d"))


def forest_sql() -> str:
    """One common table expression for each level, from one template."""
    pick = "('0x' || substr(md5('{0}:' || {1} || ':' || {2}), 1, 8))::BIGINT"
    parts = [
        "WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS p, day(o_orderdate)::DOUBLE AS d FROM orders)",
        f"w AS (SELECT *, unnest(range({TREES})) AS tree FROM o)",
        f"s0 AS (SELECT tree, 1::BIGINT AS node, p, d, row_number() OVER (PARTITION BY tree ORDER BY {pick.format('r', 'tree', 'id')}, id) <= {SAMPLE} AS s, id, 0::DOUBLE AS length, false AS done FROM w)",
    ]
    for k in range(DEPTH + 1):
        last = "true" if k == DEPTH else "false"
        parts.append(f"g{k} AS (SELECT tree, node, count(*) FILTER (s) AS n, {pick.format('a', 'tree', 'node')} % 2 AS a, {pick.format('s', 'tree', 'node')} / 4294967296.0::DOUBLE AS u, min(p) FILTER (s) AS p0, max(p) FILTER (s) AS p1, min(d) FILTER (s) AS d0, max(d) FILTER (s) AS d1 FROM s{k} WHERE NOT done GROUP BY tree, node)")
        parts.append(f"h{k} AS (SELECT *, CASE WHEN a = 0 THEN p0 ELSE d0 END AS lo, CASE WHEN a = 0 THEN p1 ELSE d1 END AS hi FROM g{k})")
        parts.append(f"t{k} AS (SELECT tree, node, n, a, lo + (hi - lo) * u AS split, {last} OR n <= 1 OR coalesce(hi - lo, 0) <= 0.001 AS leaf FROM h{k})")
        parts.append(f"""s{k + 1} AS (SELECT x.tree, CASE WHEN x.done OR leaf THEN x.node ELSE 2 * x.node + CASE WHEN CASE WHEN a = 0 THEN p ELSE d END >= split THEN 1 ELSE 0 END END AS node, p, d, s, id,
CASE WHEN x.done THEN length WHEN leaf THEN {k} + CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n::DOUBLE WHEN n = 2 THEN 1 ELSE 0 END ELSE 0 END AS length, x.done OR leaf AS done FROM s{k} x LEFT JOIN t{k} USING (tree, node))""")
    parts.append("c AS (SELECT avg(n) AS n FROM (SELECT tree, count(*) FILTER (s) AS n FROM s0 GROUP BY 1))")
    return ",\n".join(parts) + f"\nSELECT id AS o_orderkey, round(pow(2, -avg(length) / (SELECT 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n FROM c)), 4) AS score FROM s{DEPTH + 1} GROUP BY id"


@query("iforest_hash", forest_sql())
def iforest_hash(t):
    sampled = forest.samples(orders(t), "o_orderkey", ["p", "d"], TREES, SAMPLE)
    return forest.score(orders(t), forest.fit(sampled, ["p", "d"], DEPTH), ["p", "d"]).select("o_orderkey", r4("score"))


@query("iforest_incremental")
def iforest_incremental(t):
    """A forest grown on the first half of the orders that goes on growing with the second half's samples."""
    attrs = ["p", "d"]
    first, second = (forest.samples(orders(t).where(c), "o_orderkey", attrs, TREES, SAMPLE) for c in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"))
    old = forest.fit(first, attrs, 4)
    grown = forest.fit(forest.merge(first, second, SAMPLE), attrs, DEPTH, old=old)
    return forest.score(orders(t), grown, attrs).select("o_orderkey", r4("score"))


@query("iforest_random")
def iforest_random(t):
    """A random forest on hashed samples, over two attributes of all orders."""
    nodes = forest.fit_by_key(orders(t), [], ["p", "d"], trees=50, subsample=128).drop(models.ALL)
    return forest.score(orders(t), nodes, ["p", "d"]).select("o_orderkey", r4("score"))


@query("iforest_keyed")
def iforest_keyed(t):
    """A random forest for each priority, that scores the orders of its own key."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("p"), F.dayofmonth("o_orderdate").cast("double").alias("d"))
    nodes = forest.fit_by_key(rows, ["o_orderpriority"], ["p", "d"], trees=25, subsample=64)
    return forest.score(rows, nodes, ["p", "d"], keys=["o_orderpriority"]).select("o_orderkey", r4("score"))


@query("spectral_residue")
def spectral_residue(t):
    rows = t("events").select("user_id", "event_id", "value")
    return projection.spectral_residue(rows, ["user_id"], "value", "event_id", "event_id", 16).select("event_id", r4("score"))


@query("autoencoder")
def autoencoder(t):
    attrs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = t("lineitem").select("l_orderkey", "l_linenumber", *attrs)
    model = projection.fit_autoencoder(rows, attrs, 2, sample=5_000)
    return projection.regeneration_error(rows, attrs, model).select("l_orderkey", "l_linenumber", round_to(F.col("score"), 3).alias("score"))
