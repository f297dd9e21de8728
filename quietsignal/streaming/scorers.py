"""The detectors over streams: models joined to micro-batches, and state for sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quietsignal.functions.score import tag
from quietsignal.operators import record
from quietsignal.operators.record import Settings
from quietsignal.operators.series import LEAST_PROBABILITY

def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", kind: str = "parquet", files_per_batch: int = 1, **options: str) -> DataFrame:
    """Files of a folder in the order of their times, some per micro-batch."""
    reader = spark.readStream.schema(schema).format(kind).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false")
    return reader.options(**options).load(folder)


def split_entity(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Text lines (``value``) as entity (before the first separator) and record (after it)."""
    at = F.instr("value", sep)
    return lines.select(F.when(at > 0, F.substring_index("value", sep, 1)).otherwise(F.col("value")).alias("entity"), F.when(at > 0, F.expr(f"substring(value, instr(value, '{sep}') + {len(sep)})")).otherwise("").alias("record"))


def read_queue(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic as ``value`` lines (the connector must be on the class path)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("value").cast("string").alias("value"))


def score(stream: DataFrame, model: DataFrame, strategy: str, s: Settings) -> DataFrame:
    """``score`` and ``tag`` for each row of a stream, by a model of ``record.fit``.

    Every strategy of ``record.apply`` serves streams unchanged: a stream joined with a static model.
    """
    return record.apply(stream, model, strategy, s).withColumn("tag", tag(F.col("score"), s.threshold, s.polarity, s.low))


def metric(transitions: dict[tuple[str, str], float], strategy: str) -> Callable[[str, str], tuple[float, float]]:
    """What a transition adds to the two sums whose ratio is the score, as the batch metrics have it.

    A transition that is not among them has probability 0, as in batches.
    """
    best: dict[str, tuple] = {}
    entropy: dict[str, float] = {}
    own = lambda p: -p * np.log(p) if p > 0 else 0.0
    for (a, b), p in transitions.items():
        best[a] = min(best.get(a, (1.0, "")), (-p, b))
        entropy[a] = entropy.get(a, 0.0) + own(p)
    p = lambda a, b: transitions.get((a, b), 0.0)
    kinds: dict[str, Callable[[str, str], tuple[float, float]]] = {
        "conditionalProbability": lambda a, b: (-np.log(max(p(a, b), LEAST_PROBABILITY)), 1.0),
        "missProbability": lambda a, b: (1 - p(a, b), 1.0),
        "missRate": lambda a, b: (float(best.get(a, (0, None))[1] != b), 1.0),
        "entropyReduction": lambda a, b: (entropy.get(a, 0.0) - own(transitions.get((a, b), 0.0)), entropy.get(a, 0.0)),
    }
    if strategy not in kinds:
        raise ValueError(f"unknown strategy {strategy!r}")
    return kinds[strategy]


def markov(stream: DataFrame, key: str, state: str, seq: str, transitions: dict[tuple[str, str], float], window: int, threshold: float, cumulative: bool = False, strategy: str = "conditionalProbability") -> DataFrame:
    """key, seq, score, tag: a metric (see ``metric``) over the transitions in a key's last ``window`` states (or all, ``cumulative``).

    A key's state is its last states and two running sums, so it is small and bounded.  Rows of a micro-batch are
    taken in the order of ``seq``.
    """
    kinds, of = dict(stream.dtypes), metric(transitions, strategy)
    out, kept = f"{key} {kinds[key]}, {seq} {kinds[seq]}, score double, tag string", "recent array<string>, above double, below double"

    def step(name: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        recent, above, below = (list(kept.get[0]), kept.get[1], kept.get[2]) if kept.exists else ([], 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(seq)
        scores = []
        for x in rows[state]:
            x = None if pd.isna(x) else x  # a null state makes no transition, and leaves its windows without a score
            if recent and None not in (recent[-1], x):
                one = of(recent[-1], x)
                above, below = above + one[0], below + one[1]
            recent = [*recent, x][-window:]
            if cumulative:
                scores.append(above / below if below else 0.0)
            elif len(recent) < window:
                scores.append(0.0)
            elif None in recent:
                scores.append(None)
            else:
                each = [of(*p) for p in zip(recent, recent[1:], strict=False)]
                total = sum(y for _, y in each)
                scores.append(float(sum(x for x, _ in each) / total) if total else 0.0)
        kept.update((recent, float(above), float(below)))
        yield pd.DataFrame({key: [name[0]] * len(rows), seq: rows[seq].to_numpy(), "score": pd.Series(scores, dtype="Float64"), "tag": ["I" if x is None else "O" if x > threshold else "N" for x in scores]})

    return stream.select(key, seq, state).groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def write_queue(scored: DataFrame, servers: str, topic: str, checkpoint: str, value: str = "to_json(struct(*))"):
    """A writer of rows as messages of a Kafka topic (the connector must be on the class path); ``start()`` runs it."""
    return scored.selectExpr(f"{value} AS value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def windowed_stats(stream: DataFrame, keys: list[str], ts: str, attr: str, length: str, slide: str | None, late: str) -> DataFrame:
    """Statistics of an attribute by time window, rows later than ``late`` left out; an extension over row windows."""
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(*keys, span.alias("w")).agg(F.count(attr).alias("n"), F.avg(attr).alias("mean"), F.stddev_pop(attr).alias("sd"))


def alerts(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows above the threshold, for an alert sink."""
    return scored.where(F.col("score") > threshold)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there and stop; files appear once, whatever restarts."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_refreshed_model(stream: DataFrame, load: Callable[[], DataFrame], use: Callable[[DataFrame, DataFrame], DataFrame], put: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that loads the model anew for every micro-batch and hands the scored batch to ``put``."""

    def each(batch: DataFrame, number: int) -> None:
        put(use(batch, load()), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def entity_hash(entity: str, workers: int) -> Column:
    """The worker of an entity, as a stream's grouping deals it."""
    return F.pmod(F.xxhash64(entity), F.lit(workers))
