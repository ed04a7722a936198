"""Chat formatting: conversations rebuilt from an event log, rendered with a template and a loss mask.

An event is (conv_id, seq, op, role, text, target):

    message     starts a message
    delta       adds text to a message: the one with seq = target, else the last one started
    edit        replaces a message's text; deltas that follow are added to the new text
    regenerate  withdraws the message with seq = target and all that were started since (without a
                target: the last one), and starts a message with the role given, else that of the target, which
                may have it from its own target

Events of a conversation are folded in the order of seq; ties go by op, role and text.  The log is sorted once,
dealt out by ranges, so that the parts of a long conversation lie in several tasks, and written.  What events refer to
and what is withdrawn is decided without their texts, by running sums over each part and over the parts; texts
join what is left of them.  A message's text is its last whole text (of its start or of an edit) and the deltas
after it, put together at once.  Every message is rendered into a row of its own, so a conversation of any length
needs memory for one message only.

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside texts and roles ``<``, any backslashes and ``|`` get one more backslash, so no text can hold a
control string; roles have backslashes and line feeds escaped as well.  Both are undone in reading.

Defined results: a null text or role is empty, a null op is a message, and events without a message to
change are ignored; rows with a null conv_id form one conversation; repeated rows are repeated
messages; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_MESSAGE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)
_ESCAPED = re.compile(r"<(\\*)\\\|")


_KEYS = ["seq", "op", "role", "text"]


def _scan(rows: DataFrame, value: Column, least: bool, later: bool, name: str) -> DataFrame:
    """rows with the least or largest value of the rows before them in their conversation, or after them.

    It is taken within a part of the conversation, and over whole parts; frames only grow, in either direction.
    """
    fold_, pick = (F.min, F.least) if least else (F.max, F.greatest)
    way = (lambda c: F.col(c).desc()) if later else F.col
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(way(by)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__v", value)
    parts = rows.groupBy("conv", "part").agg(fold_("__v").alias("__p"))
    parts = parts.withColumn("__carried", fold_("__p").over(before(["conv"], "part"))).drop("__p")
    rows = rows.withColumn("__own", fold_("__v").over(before(["conv", "part"], "n"))).join(parts, ["conv", "part"])
    return rows.withColumn(name, pick("__own", "__carried")).drop("__v", "__own", "__carried")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, n (order), role, text of the final messages."""
    e = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"), "target")
    # a last key, so that repeated rows can be dealt out; n is the place in the whole order, its high bits are the part
    e = e.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("tie", F.monotonically_increasing_id())
    by = ["conv", F.col("conv_id").isNull(), *_KEYS, "tie"]
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = e.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie").withColumn("n", F.monotonically_increasing_id())
    placed = common.materialize(placed, "log")
    starts = F.col("op").isin("message", "regenerate")
    slim = placed.select("conv", "n", F.shiftright("n", 33).alias("part"), "seq", "op", "role", "target")
    slim = _scan(slim, F.when(starts, F.col("n")), False, False, "previous")
    # the last message before an event whose seq is the event's target
    asked = slim.where("target is not null").select("conv", "n", F.col("target").alias("value"), F.lit(None).cast("long").alias("m"))
    there = slim.where(starts & F.col("seq").isNotNull()).select("conv", "n", F.col("seq").alias("value"), F.col("n").alias("m"))
    upto = Window.partitionBy("conv", "value").orderBy("n", F.col("m").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(there).withColumn("found", F.max("m").over(upto)).where("m is null and found is not null").select("conv", "n", "found")
    slim = slim.join(found, ["conv", "n"], "left").withColumn("aim", F.when(F.col("target").isNull(), F.col("previous")).otherwise(F.col("found")))
    slim = _scan(slim, F.when(F.col("op") == "regenerate", F.col("aim")), True, True, "back_to")
    slim = slim.withColumn("message", F.when(starts, F.col("n")).otherwise(F.col("aim"))).where("message is not null")
    slim = common.materialize(slim.select("conv", "n", "op", "role", "aim", "message", (starts & (F.coalesce("back_to", F.lit(1 << 62)) > F.col("n"))).alias("alive")), "decided")
    each = slim.groupBy("conv", "message").agg(
        F.max("alive").alias("alive"),
        F.max(F.when(starts, F.col("role"))).alias("role"),
        F.max(F.when((F.col("op") == "regenerate") & F.col("role").isNull(), F.col("aim"))).alias("as"),
        F.max(F.when(F.col("op") != "delta", F.col("n"))).alias("whole"),
    )
    each = _inherited(common.materialize(each, "messages"))
    kept = slim.select("conv", "n", "message").join(each.where("alive").select("conv", "message", "role", "whole"), ["conv", "message"]).where("n >= whole")
    texts = placed.select("n", "conv_id", "text").join(kept.select("n", "message", "role"), "n")
    log = F.array_sort(F.collect_list(F.struct("n", "text")))
    return texts.groupBy("conv_id", "message", "role").agg(F.array_join(F.transform(log, lambda x: x["text"]), "").alias("text")).select(
        "conv_id", F.col("message").alias("n"), F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def _inherited(each: DataFrame) -> DataFrame:
    """Messages with the roles that regenerations have from what they replaced, along chains of them, which halve in each round."""
    open_ = F.col("role").isNull() & F.col("as").isNotNull()
    while each.where(open_).limit(1).count():
        of = each.select("conv", F.col("message").alias("as"), F.col("role").alias("__role"), F.col("as").alias("__as"))
        asked = each.where(open_).drop("role").join(of, ["conv", "as"], "left").withColumn("as", F.col("__as")).withColumnRenamed("__role", "role").drop("__as")
        each = common.materialize(each.where(~open_).unionByName(asked), "messages")
    return each


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, n, formatted, loss_start, loss_chars: the place in formatted, in code points, of what is
    learned from; nulls for messages of other roles.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    mine = F.col("role") == learn
    return messages.select(
        "conv_id", "n", F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("formatted"),
        F.when(mine, F.length(head)).alias("loss_start"), F.when(mine, F.length(escape(F.col("text")))).alias("loss_chars"),
    )


def format_log(events: DataFrame) -> DataFrame:
    """Folds and renders a log; the output is written to the shared folder as a table and read again."""
    return common.materialize(render(fold(events)), "chat")


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    m = _MESSAGE.fullmatch(formatted)
    if not m:
        raise ValueError("not a rendered message")
    return unescape_role(m[1]), unescape(m[2])


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the rendered messages: turns, hashes of them and of what the loss mask holds."""
    common.ready(rendered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = object(), None, []

        def close() -> None:
            if state:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, text, at, n in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_chars")), strict=True):
                if conv != key or state is None:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[4] += len(text)
                if at is not None:
                    learned = unescape(text[at : at + n])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if out:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    ordered = rendered.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", "n")
    return ordered.mapInArrow(run, DIGEST)
