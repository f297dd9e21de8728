"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context and only its reply is
trainable.  Each turn is rendered as a segment ``<|role|>text<|end|>``, and an example is the whole text of the
segments up to its reply.  Turns after the last reply stand in a last row that trains nothing.

Conversations are expanded and read back in streams over rows sorted by conversation and turn.  Examples are
quadratic in a conversation's turns by nature; a task holds the text of one conversation, which is its largest
example, and a bounded number of characters of examples that are on their way out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import SLICE_CHARS, table

OPEN, SHUT, END = "<|", "|>", "<|end|>"
#: What stands for the characters of the template's marks inside texts and roles.  The ampersand comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def format_turns(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, position (0, 1, ... by turn), segment, context_chars, and for a trainable turn
    loss_start and loss_end (characters of its segment, end exclusive; null otherwise).

    A row with a loss span is a training example: the conversation's segments before ``position`` and this one.
    Null roles and texts count as empty.  Turns of equal number follow by role, then text; repeated rows stay.
    A null turn comes first; rows with a null conv_id form one conversation.  Other columns are not read.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT))
    reply = F.when(F.col("role") == trainable, F.length(head))
    return (
        turns.withColumn("segment", F.concat(head, escape(F.col("text")), F.lit(END)))
        .withColumn("loss_start", reply.cast("long"))
        .withColumn("loss_end", F.when(F.col("loss_start").isNotNull(), F.length("segment") - len(END)).cast("long"))
        .withColumn("position", F.row_number().over(order) - 1)
        .withColumn("context_chars", F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .select("conv_id", "position", "segment", "context_chars", "loss_start", "loss_end")
    )


def expand(turns: DataFrame) -> DataFrame:
    """The examples in full, one a row, by conversation and example within a partition: conv_id, example (1, 2, ...),
    parent (the example that this one goes on from; 0: none), position (of its last turn), formatted (all segments up
    to that turn), loss_start and loss_end (characters of formatted: the reply), and trains.

    The turns after a conversation's last reply end a last row, which holds the whole conversation and trains nothing:
    its loss span is null.  A conversation's text may have 2 GB, as any value of a column.
    """
    last = F.lead("position").over(Window.partitionBy("conv_id").orderBy("position")).isNull()
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "example", "parent", "position", "formatted", "loss_start", "loss_end", "trains"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, example, held, done = "", 0, 0, []

        def out(conv: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            types = [conv, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            conv_type = batch.column(0).type
            for conv, position, segment, start, end, ends in zip(*(batch.column(k).to_pylist() if k != 2 else batch.column(k) for k in range(6)), strict=True):
                before = len(whole)
                whole += segment.as_py()
                if start is not None or ends:
                    example += 1
                    span = (None, None) if start is None else (before + start, before + end)
                    done.append((conv, example, example - 1, position, whole, *span, start is not None))
                    held += len(whole)
                if ends:
                    whole, example = "", 0
                if held > SLICE_CHARS:
                    yield out(conv_type)
                    held = 0
            yield out(conv_type)
            held = 0

    rows = turns.select("conv_id", "position", "segment", "loss_start", "loss_end", last.alias("ends")).sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(work, f"conv_id {kind}, example long, parent long, position int, formatted string, loss_start long, loss_end long, trains boolean")


def written_out(examples: DataFrame) -> DataFrame:
    """The examples that train: conv_id, position, formatted, loss_start, loss_end (characters of formatted)."""
    return examples.where("trains").select("conv_id", "position", "formatted", "loss_start", "loss_end")


class Reader:
    """What is read back of one conversation, example by example."""

    def __init__(self) -> None:
        self.loss, self.last = hashlib.sha256(), ""
        self.loss_chars = self.n_examples = self.example_chars = 0

    def add(self, formatted: str, begin: int | None, end: int | None) -> None:
        self.last = formatted
        if begin is not None:
            said = plain(formatted[begin:end])
            self.loss.update(said.encode("utf-8", "surrogatepass"))
            self.loss_chars, self.n_examples, self.example_chars = self.loss_chars + len(said), self.n_examples + 1, self.example_chars + len(formatted)

    def row(self) -> tuple:
        """The turns are those of the last example, which holds the conversation."""
        turns, n_turns, at = hashlib.sha256(), 0, 0
        while at < len(self.last):
            shut = self.last.index(SHUT, at + len(OPEN))
            end = self.last.index(END, shut + len(SHUT))
            for x in (self.last[at + len(OPEN) : shut], "\n", self.last[shut + len(SHUT) : end], "\n"):
                turns.update(plain(x).encode("utf-8", "surrogatepass"))
            n_turns, at = n_turns + 1, end + len(END)
        return n_turns, turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), len(self.last), self.n_examples, self.example_chars


def plain(text: str) -> str:
    for mark, safe in reversed(ESCAPES):
        text = text.replace(safe, mark)
    return text


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"


def read_back(examples: DataFrame, dealt: bool = False) -> DataFrame:
    """Digests of each conversation, from nothing but the examples' texts and loss spans.

    ``dealt``: the examples come straight from ``expand``, dealt by conversation and in order.  A null conv_id is a
    conversation of its own; no examples give no rows.  Texts under the loss mask follow each other in order of the examples.
    """
    names = ["conv_id", *[x.split()[0] for x in DIGESTS.split(", ")]]
    kind = examples.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            types = [batch_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        batch_type = pa.int64()
        for batch in batches:
            batch_type = batch.column(0).type
            rows = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for conv, formatted, begin, end in rows:
                if reader is None or conv != at:
                    if reader is not None:
                        done.append((at, *reader.row()))
                    at, reader = conv, Reader()
                reader.add(formatted.as_py(), begin, end)
            yield out()
        if reader is not None:
            done.append((at, *reader.row()))
        yield out()

    ordered = examples if dealt else examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(work, f"conv_id {kind}, {DIGESTS}")


def op8_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(expand(format_turns(talks.unionByName(planted))), dealt=True)


#: The same digests straight from the table; lengths of the rendering follow from the texts and the escapes.
OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 11 AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples,
       coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM s GROUP BY conv_id
"""
