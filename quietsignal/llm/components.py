"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import shared_checkpoints


#: Parts into which the neighbours of a node are dealt where they meet its smallest one.
SALT = 8


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that a row (a, b) of ``links`` names.

    Large-star and small-star steps in turn: each node's greater (then smaller) neighbours are hung on the
    smallest; the links shrink to one star for each component in about a logarithm of its length of rounds.
    Rounds go on until the links are stars: each node hangs on one other, and that one on none.  The centre of a
    star is a hot key, so its neighbours are dealt to SALT parts.  Each round is cut from its past by a
    checkpoint; nothing but a count reaches the driver.  Rows with nulls and links of a node to itself are left
    out; no links give no rows.
    """
    shared_checkpoints(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().checkpoint()
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u: a neighbour of v
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count_if(F.expr("u < v")).alias("below"), F.count_if(F.expr("u > v")).alias("above")).checkpoint()
        # Stars: no node has two smaller neighbours, or one besides a greater one.
        if least.where("below > 1 OR below > 0 AND above > 0").isEmpty():
            break
        dealt = both.where("u > v").withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALT)).cast("int"))
        every = least.where("above > 0").select("v", "m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        large = dealt.join(every, ["v", "salt"]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        # Every u is below its v here; a node is in as many rows as stars had it.
        small = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        edges = small.select(pairs.alias("p")).select("p.*").where("v <> u").distinct().checkpoint()
    hanging = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return hanging.unionByName(hanging.select(F.col("component").alias("node"), "component").distinct())
