"""Seeded test data with planted outliers, as distributed tables.

Numbers come from hashed row ids, so a table is the same however it is partitioned.  Every table has a column
``planted`` (true where an outlier was put in).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(salt: str, *of: str | Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def normal(salt: str, mean: Column | float, sd: Column | float, *of: str | Column) -> Column:
    z = F.sqrt(-2 * F.ln(uniform(salt + "1", *of))) * F.cos(2 * math.pi * uniform(salt + "2", *of))
    return (mean if isinstance(mean, Column) else F.lit(float(mean))) + z * sd


def grid(spark: SparkSession, names: int, steps: int, start: int, step: int) -> DataFrame:
    """id (name number), k (step number) and ts (seconds) of every name and step."""
    rows = spark.range(names * steps).withColumnRenamed("id", "row")
    return rows.select("row", F.floor(F.col("row") / steps).cast("long").alias("id"), (F.col("row") % steps).alias("k")).withColumn("ts", F.lit(start) + F.col("k") * step)


def cpu_usage(spark: SparkSession, servers: int = 4, days: int = 10, share: float = 0.08, start: int = 1_700_000_000) -> DataFrame:
    """server, ts, day, usage: higher on weekdays; planted readings of 94 to 100 on weekdays, 54 to 100 on weekends."""
    day = F.pmod(F.floor(F.col("ts") / 86_400), F.lit(7)).cast("int")
    rows = grid(spark, servers, days * 288, start, 300).withColumn("day", day)
    base = F.when(F.col("day") < 5, normal("u", 60, 12, "row")).otherwise(normal("u", 30, 8, "row"))
    high = F.when(F.col("day") < 5, 94 + 6 * uniform("h", "row")).otherwise(54 + 46 * uniform("h", "row"))
    rows = rows.withColumn("planted", uniform("p", "row") < share)
    usage = F.when(F.col("planted"), high).otherwise(base)
    return rows.select(F.concat(F.lit("s"), "id").alias("server"), "ts", "day", F.greatest(F.lit(0), F.least(F.lit(100), F.round(usage))).cast("int").alias("usage"), "planted")


def blood_sugar(spark: SparkSession, devices: int = 20, readings: int = 500, share: float = 0.01) -> DataFrame:
    """device, ts, reading: runs of readings of 120 to 200 or 60 to 80 are planted."""
    rows = grid(spark, devices, readings, 1_700_000_000, 600).withColumn("run", F.floor(F.col("k") / 5).cast("long"))
    rows = rows.withColumn("planted", uniform("p", "id", "run") < share)
    odd = F.when(uniform("s", "id", "run") < 0.5, 120 + 80 * uniform("v", "row")).otherwise(60 + 20 * uniform("v", "row"))
    return rows.select(F.concat(F.lit("d"), "id").alias("device"), "ts", F.round(F.when(F.col("planted"), odd).otherwise(normal("n", 100, 6, "row"))).cast("int").alias("reading"), "planted")


def vibration(spark: SparkSession, machines: int = 3, steps: int = 4000, onset: float = 0.8) -> DataFrame:
    """machine, ts (ms), value: four harmonics with noise; after ``onset`` the last machine has two high ones more."""
    rows = grid(spark, machines, steps, 0, 10)
    wave = sum((F.lit(a) * F.sin(2 * math.pi * F.col("k") * f) for a, f in ((10.0, 0.01), (6.0, 0.02), (4.0, 0.04), (2.0, 0.05))), F.lit(0.0))
    fault = F.lit(12.0) * F.sin(2 * math.pi * F.col("k") * 0.21) + F.lit(9.0) * F.sin(2 * math.pi * F.col("k") * 0.33)
    rows = rows.withColumn("planted", (F.col("id") == machines - 1) & (F.col("k") >= int(onset * steps)))
    return rows.select(F.concat(F.lit("m"), "id").alias("machine"), "ts", (wave + normal("n", 0, 3, "row") + F.when(F.col("planted"), fault).otherwise(0.0)).alias("value"), "planted")


def cannibalised_sale(spark: SparkSession, products: int = 4, steps: int = 600) -> DataFrame:
    """product, ts, qty: trend and cycle; the last product falls from 60 % of its steps on and then stays at a new level."""
    rows = grid(spark, products, steps, 1_700_000_000, 86_400)
    cut = int(0.6 * steps)
    base = 200 + 0.05 * F.col("k") + 20 * F.sin(2 * math.pi * F.col("k") / 7)
    fall = F.least(F.greatest(F.col("k") - cut, F.lit(0)), F.lit(30)) * 3
    rows = rows.withColumn("planted", (F.col("id") == products - 1) & (F.col("k") >= cut))
    return rows.select(F.concat(F.lit("p"), "id").alias("product"), "ts", F.round(base - F.when(F.col("planted"), fall).otherwise(0) + normal("n", 0, 8, "row")).cast("int").alias("qty"), "planted")


def product_sale(spark: SparkSession, products: int = 10, steps: int = 500, share: float = 0.02) -> DataFrame:
    """type, product, ts, qty: +200 (3 of 10) or -300, not below 0, is planted."""
    rows = grid(spark, products, steps, 1_700_000_000, 3600).withColumn("planted", uniform("p", "row") < share)
    usual = normal("n", 120 + 10 * F.sin(2 * math.pi * F.col("k") / 24), 10, "row")
    odd = F.when(uniform("s", "row") < 0.3, usual + 200).otherwise(usual - 300)
    return rows.select(F.lit("prodSale").alias("type"), F.concat(F.lit("p"), "id").alias("product"), "ts", F.greatest(F.lit(0), F.round(F.when(F.col("planted"), odd).otherwise(usual))).cast("int").alias("qty"), "planted")


def cart_abandonment(spark: SparkSession, shops: int = 3, steps: int = 500, share: float = 0.02) -> DataFrame:
    rows = grid(spark, shops, steps, 1_700_000_000, 3600).withColumn("planted", uniform("c", "row") < share)
    return rows.select(F.lit("cartAbandon").alias("type"), F.concat(F.lit("c"), "id").alias("id"), "ts", F.round(F.when(F.col("planted"), 15 + 10 * uniform("v", "row")).otherwise(5 + 4 * uniform("v", "row"))).cast("int").alias("qty"), "planted")


def inventory(spark: SparkSession, products: int = 5, steps: int = 300) -> DataFrame:
    """type, product, ts, qty, inventory: stock falls by the sales of a cycle and is filled again."""
    rows = product_sale(spark, products, steps, 0.0)
    place = F.pmod(F.floor(F.col("ts") / 3600), F.lit(48))
    return rows.select("type", "product", "ts", "qty", (F.lit(8000) - place * 120).cast("int").alias("inventory"), "planted")


def order_process(spark: SparkSession, count: int = 2000, share: float = 0.03) -> DataFrame:
    """order, categories, ts, previous and current state (1 to 11), seconds taken, agent and experience; long times are planted."""
    rows = spark.range(count).withColumnRenamed("id", "row").withColumn("planted", uniform("p", "row") < share)
    state = (1 + F.floor(11 * uniform("s", "row"))).cast("int")
    usual = normal("t", 600 + 60 * state, 60, "row")
    return rows.select(F.concat(F.lit("o"), "row").alias("order_id"), (1 + F.floor(4 * uniform("c", "row"))).cast("int").alias("num_cat"), (F.lit(1_700_000_000) + F.col("row") * 30).alias("ts"), (state - 1).alias("prev_state"), state.alias("cur_state"), F.round(usual + F.when(F.col("planted"), 60 * (8 + 4 * uniform("x", "row"))).otherwise(0)).cast("int").alias("elapsed"), F.concat(F.lit("a"), (F.floor(20 * uniform("a", "row"))).cast("int")).alias("agent"), (1 + F.floor(10 * uniform("e", "row"))).cast("int").alias("agent_exp"), "planted")


def tickets(spark: SparkSession, count: int = 2000, share: float = 0.02) -> DataFrame:
    """company, ticket, severity, priority, hours, calls, messages, sentiment, reopened; 30 to 50 hours more are planted."""
    rows = spark.range(count).withColumnRenamed("id", "row").withColumn("planted", uniform("p", "row") < share)
    severity, priority = (1 + F.floor(3 * uniform("s", "row"))).cast("int"), (1 + F.floor(2 * uniform("q", "row"))).cast("int")
    hours = normal("h", 8 + 4 * severity + 3 * priority, 2, "row") + F.when(F.col("planted"), 30 + 20 * uniform("x", "row")).otherwise(0)
    return rows.select(F.concat(F.lit("c"), F.floor(10 * uniform("c", "row")).cast("int")).alias("company"), F.col("row").alias("ticket_id"), severity.alias("severity"), priority.alias("priority"), F.round(hours).cast("int").alias("service_hours"), F.round(normal("k", 3, 1, "row") + F.when(F.col("planted"), 8).otherwise(0)).cast("int").alias("calls"), F.round(normal("m", 6, 2, "row")).cast("int").alias("messages"), normal("f", 0.5, 0.1, "row").alias("sentiment"), (uniform("r", "row") < 0.1).cast("int").alias("reopened"), "planted")


def web_sessions(spark: SparkSession, count: int = 2000, share: float = 0.05) -> DataFrame:
    """user, hour, pages, seconds a page, share of reviews, cart, checkout, logout; bots view many pages fast and never check out."""
    rows = spark.range(count).withColumnRenamed("id", "row").withColumn("planted", uniform("p", "row") < share)
    bot = F.col("planted")
    flag = lambda salt, a, b: (uniform(salt, "row") < F.when(bot, a).otherwise(b)).cast("int")
    return rows.select(F.concat(F.lit("u"), "row").alias("user"), F.floor(24 * uniform("h", "row")).cast("int").alias("hour"), F.round(F.when(bot, normal("g", 80, 10, "row")).otherwise(normal("g", 12, 3, "row"))).cast("int").alias("pages"), F.when(bot, normal("t", 2, 0.5, "row")).otherwise(normal("t", 40, 10, "row")).alias("seconds"), F.when(bot, normal("r", 0.9, 0.03, "row")).otherwise(normal("r", 0.3, 0.1, "row")).alias("review_share"), flag("c", 0.7, 0.5).alias("cart"), flag("o", 0.02, 0.3).alias("checkout"), flag("l", 0.05, 0.8).alias("logout"), bot.alias("planted"))


def quarantine(spark: SparkSession, phones: int = 20) -> DataFrame:
    """phone, lat_lo, long_lo, lat_hi, long_hi: a box for each phone."""
    rows = spark.range(phones).withColumnRenamed("id", "row")
    lat, long = 35 + 5 * uniform("a", "row"), -120 + 5 * uniform("o", "row")
    return rows.select(F.concat(F.lit("p"), "row").alias("phone"), (lat - 0.001).alias("lat_lo"), (long - 0.001).alias("long_lo"), (lat + 0.001).alias("lat_hi"), (long + 0.001).alias("long_hi"))


def locations(spark: SparkSession, phones: int = 20, steps: int = 100, share: float = 0.05) -> DataFrame:
    """phone, ts, lat, long inside the phone's box; walks out of it, for runs of 5 samples, are planted."""
    rows = grid(spark, phones, steps, 1_700_000_000, 300).withColumn("run", F.floor(F.col("k") / 5).cast("long")).withColumn("planted", uniform("p", "id", "run") < share)
    boxes = quarantine(spark, phones)
    away = F.when(F.col("planted"), 0.004 + 0.002 * uniform("w", "row")).otherwise(0.0)
    joined = rows.withColumn("phone", F.concat(F.lit("p"), "id")).join(F.broadcast(boxes), "phone")
    return joined.select("phone", "ts", ((F.col("lat_lo") + F.col("lat_hi")) / 2 + 0.0016 * (uniform("x", "row") - 0.5) + away).alias("lat"), ((F.col("long_lo") + F.col("long_hi")) / 2 + 0.0016 * (uniform("y", "row") - 0.5) + away).alias("long"), "planted")


def classifier_errors(spark: SparkSession, streams: int = 4, steps: int = 2000, at: float = 0.6, before: float = 0.1, after: float = 0.4) -> DataFrame:
    """id, ts, err, err2: the error rate changes at a share of the stream; err2 is a learner that adapts."""
    rows = grid(spark, streams, steps, 0, 1).withColumn("planted", F.col("k") >= int(at * steps))
    return rows.select("id", "ts", (uniform("e", "row") < F.when(F.col("planted"), after).otherwise(before)).cast("int").alias("err"), (uniform("f", "row") < before).cast("int").alias("err2"), "planted")


def churn(spark: SparkSession, count: int = 2000, shift: float = 0.0) -> DataFrame:
    """id, seven features, class; the second half's features are moved by ``shift`` deviations."""
    rows = spark.range(count).withColumn("late", F.col("id") >= count // 2)
    features = [(normal(f"f{i}", 10 * i, i, "id") + F.when(F.col("late"), shift * i).otherwise(0.0)).alias(f"f{i}") for i in range(1, 8)]
    return rows.select("id", *features, F.when(uniform("y", "id") < 0.3, "Y").otherwise("N").alias("cls"), "late")


def card_transactions(spark: SparkSession, count: int = 2000, share: float = 0.01) -> DataFrame:
    """xid, minute of the day, amount, vendor; large night-time amounts are planted."""
    rows = spark.range(count).withColumn("planted", uniform("p", "id") < share)
    vendors = F.array(*[F.lit(v) for v in ("grocery", "fuel", "travel", "clothing", "electronics")])
    return rows.select(F.concat(F.lit("x"), "id").alias("xid"), F.floor(F.when(F.col("planted"), 120 + 120 * uniform("m", "id")).otherwise(480 + 840 * uniform("m", "id"))).cast("int").alias("minute"), F.when(F.col("planted"), 900 + 600 * uniform("a", "id")).otherwise(F.abs(normal("a", 60, 30, "id"))).alias("amount"), F.get(vendors, F.floor(5 * uniform("v", "id")).cast("int")).alias("vendor"), "planted")


def transaction_states(spark: SparkSession, customers: int = 50, steps: int = 60, share: float = 0.05) -> DataFrame:
    """customer, ts, state of 18 (amount L/M/H, price N/H, time L/N/S); a planted customer jumps about at random."""
    rows = grid(spark, customers, steps, 0, 1).withColumn("planted", uniform("p", "id") < share)
    part = lambda salt, names, calm: F.get(F.array(*[F.lit(n) for n in names]), F.floor(len(names) * F.when(F.col("planted"), uniform(salt, "row")).otherwise(uniform(salt, "row") * calm)).cast("int"))
    return rows.select(F.concat(F.lit("c"), "id").alias("customer"), "ts", F.concat(part("a", "LMH", 0.45), part("b", "NH", 0.6), part("c", "LNS", 0.5)).alias("state"), "planted")


def streams_hierarchy() -> list[tuple]:
    """(type, id, parentType, parentId, singleton) of a shop: ten products in two departments, carts, sales, one organisation."""
    rows = [("prodSale", f"p{i}", "dept", f"d{i % 2}", False) for i in range(10)]
    rows += [("dept", f"d{i}", "sale", "sale0", False) for i in range(2)]
    return [*rows, ("cartAbandon", "", "sale", "sale0", True), ("sale", "sale0", "org", "org0", False)]
