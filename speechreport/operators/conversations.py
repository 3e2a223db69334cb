"""Chat histories over rows (conv_id, turn, role, text), and replies that become part of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from speechreport.functions.columns import stripped
from speechreport.operators.inference import PORTION, TASK_CHARS, Engines, answers, dealt, marked
from speechreport.streaming.chunks import STORE

#: Rows that asking a conversation's turns gives.
REPLIES = "conv_id {key}, turn {turn}, model string, n_messages int, reply string, status int, error string"
#: Time that a conversation of a stream may rest before its history is forgotten.
REST_MS = 86_400_000
NO_TURN = -(1 << 62)


def last_user_turn(df: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of each conversation's last user turn; status 400 where there is none."""
    user = F.col("role") == "user"
    found = df.groupBy("conv_id").agg(F.max(F.when(user, F.col("turn"))).alias("turn"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("text"))
    return found.withColumn("status", F.when(F.col("turn").isNull(), 400))


def chat_history(df: DataFrame, system: str | None = None) -> DataFrame:
    """(conv_id, turn, history) for each user turn: all messages up to it, the system prompt first.

    Turns without text are skipped. ``system`` is put in front of conversations that have no system turn.
    """
    said = df.filter(F.length(stripped(F.coalesce("text", F.lit("")))) > 0)
    order = Window.partitionBy("conv_id").orderBy((F.col("role") != "system").cast("int"), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(order)
    if system is not None:
        first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
        history = F.when(F.max(F.col("role") == "system").over(whole), history).otherwise(F.concat(first, history))
    return said.select("conv_id", "turn", "role", history.alias("history")).filter("role = 'user'").drop("role")


def _placed(df: DataFrame) -> DataFrame:
    """User and system turns with text, without white space at their ends; a turn without a number or conversation has no place."""
    said = df.withColumn("text", stripped(F.coalesce("text", F.lit(""))))
    return said.filter((F.length("text") > 0) & F.col("role").isin("user", "system") & F.col("turn").isNotNull() & F.col("conv_id").isNotNull())


def _sorted_turns(role: str) -> Column:
    """A conversation's (turn, text) of a role in order, each turn once, with its least text."""
    found = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    return F.filter(found, lambda x, i: (i == 0) | (x["turn"] != F.get(found, i - 1)["turn"]))


def _ask(histories: list[list[dict]], models: list[str | None], failed: list[bool], engines: dict) -> list[tuple[str | None, int | None, str | None]]:
    """(reply, status, error) of each history, to which its reply is added; nothing is asked where an earlier turn failed."""
    open_ = [i for i, bad in enumerate(failed) if not bad]
    found: list = [(None, 424, "an earlier turn failed")] * len(histories)
    # an engine may keep the list that it gets, so each call has its own
    for i, got in zip(open_, answers([(models[i], list(histories[i])) for i in open_], engines), strict=True):
        found[i], failed[i] = got, got[1] is not None
        if not failed[i]:
            histories[i].append({"role": "assistant", "content": got[0]})
    return found


def chat_replies(df: DataFrame, engines: Engines, model: str = "model", system: str | None = None, cleanup: list[Callable[[], object]] | None = None) -> DataFrame:
    """(conv_id, turn, model, n_messages, reply, status, error) for each user turn of rows (conv_id, turn, role, text, model).

    Each turn is asked with all that was said before: the conversation's system turns, or else ``system``, its user turns, and
    the replies that the engine itself gave to them; logged replies are not read. n_messages counts what was sent. Turns
    without text are skipped, rows without conv_id or turn left out, of rows that share a turn the one with the least text
    counts. The model is that of the conversation's first row. A turn that fails has status 502, also if no engine goes by
    its model's name; later turns of the conversation are not asked and have status 424. An empty table gives no rows.

    A turn needs the reply before it, so one task holds a conversation, whatever its length. Conversations are dealt to
    tasks by their characters times their turns, and a task asks for the next turns of up to PORTION conversations at once.
    """
    known, types = marked(engines), dict(df.dtypes)
    first = F.min_by(F.col(model), F.struct("turn", "text", model))
    turns = _placed(df).groupBy("conv_id").agg(first.alias("model"), _sorted_turns("user").alias("said"), _sorted_turns("system").alias("told"))
    heavy = F.aggregate("said", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"])) * F.size("said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kinds = [whole.schema.field("conv_id").type, whole.schema.field("said").type.value_type.field("turn").type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            for at in range(0, whole.num_rows, PORTION):
                rows = whole.slice(at, PORTION).to_pylist()
                histories = [[{"role": "system", "content": x["text"]} for x in r["told"]] or opening(system) for r in rows]
                failed, step = [False] * len(rows), 0
                while live := [i for i, r in enumerate(rows) if len(r["said"]) > step]:
                    said = [rows[i]["said"][step] for i in live]
                    for i, x in zip(live, said, strict=True):
                        histories[i].append({"role": "user", "content": x["text"]})
                    sent, bad, models = [0 if failed[i] else len(histories[i]) for i in live], [failed[i] for i in live], [rows[i]["model"] for i in live]
                    got = _ask([histories[i] for i in live], models, bad, known)
                    for i, now in zip(live, bad, strict=True):
                        failed[i] = now
                    columns = [[rows[i]["conv_id"] for i in live], [x["turn"] for x in said], models, sent, *([g[k] for g in got] for k in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)
                    step += 1

    return dealt(turns, "model", "conv_id", heavy, TASK_CHARS, cleanup).mapInArrow(run, REPLIES.format(key=types["conv_id"], turn=types["turn"]))


NAMES = ["conv_id", "turn", "model", "n_messages", "reply", "status", "error"]


def opening(system: str | None) -> list[dict]:
    return [] if system is None else [{"role": "system", "content": system}]


class Dialogue(StatefulProcessor):
    """What was said in a conversation, a list to which a turn only appends, and one mark of how far it has come."""

    def __init__(self, engines: dict, system: str | None, rest_ms: int | None):
        self.engines, self.system, self.rest_ms = engines, system, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "role string, content string")
        self.mark = handle.getValueState("mark", "last long, failed boolean, model string, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # plain tuples, as a conversation has few rows and each call of a frame takes longer than they do
        new = [x for part in rows for x in zip(*(part[c].tolist() for c in ("turn", "text", "role", "model", "ms")), strict=True)]
        new = sorted(((*x[:3], x[3] if isinstance(x[3], str) else None, x[4]) for x in new), key=lambda x: (*x[:2], x[3] is None, x[3] or ""))
        users: dict[int, str] = {}
        told: dict[int, str] = {}
        for turn, text, role, *_ in new:
            if role in ("user", "system"):
                (users if role == "user" else told).setdefault(turn, text)
        known = self.mark.get() if self.mark.exists() else None
        # turns that were all asked before need no history
        history = [{"role": r, "content": c} for r, c in self.said.get()] if known and max(users, default=NO_TURN) > known[0] else []
        kept, out = len(history), []
        if known:
            last, failed, model, timer = known
        else:
            last, failed, model, timer = NO_TURN, False, new[0][3], -1
            history = [{"role": "system", "content": x} for x in told.values()] or opening(self.system)
        for turn, text in users.items():
            if turn > last:
                history.append({"role": "user", "content": text})
                sent, bad = 0 if failed else len(history), [failed]
                out.append((key[0], turn, model, sent, *_ask([history], [model], bad, self.engines)[0]))
                last, failed = turn, bad[0]
        if history[kept:]:
            self.said.appendList([(m["role"], m["content"]) for m in history[kept:]])
        if self.rest_ms is not None:
            until = max(timerValues.getCurrentWatermarkInMs(), max(x[4] for x in new)) + self.rest_ms
            if until > timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(until)
                timer = until
        self.mark.update((last, failed, model, timer))
        if out:
            yield pd.DataFrame(out, columns=NAMES).astype({"n_messages": "int32", "status": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.said.clear()
        self.mark.clear()
        yield from ()

    def close(self) -> None:
        pass


def chat_stream(stream: DataFrame, engines: Engines, model: str = "model", system: str | None = None, time: str | None = None, rest_ms: int = REST_MS, watermark: str = "10 minutes") -> DataFrame:
    """The same rows for a stream of turns: each is asked as it comes, with what its conversation's state holds.

    Turns of one batch are asked in their order; one that comes when it or a later turn has been asked gives no row, so
    repeated turns do no harm. System turns count if they come in the conversation's first batch. ``time`` names a column of
    event times: a conversation that rests for ``rest_ms`` of them is forgotten and begins anew, and turns without a time are
    left out. Without such a column all histories are kept, which suits streams that end. Turns are whole numbers.
    The session's state store is set to one that has lists.
    """
    stream.sparkSession.conf.set(*STORE)
    turns = _placed(stream) if time is None else _placed(stream).filter(F.col(time).isNotNull()).withWatermark(time, watermark)
    ms = F.lit(0).cast("long") if time is None else F.unix_millis(time)
    columns = ["conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col(model).alias("model"), ms.alias("ms")]
    grouped = turns.select(*columns, *([] if time is None else [F.col(time).alias("_time")])).groupBy("conv_id")
    dialogue = Dialogue(marked(engines), system, None if time is None else rest_ms)
    schema = REPLIES.format(key=dict(stream.dtypes)["conv_id"], turn="long")
    return grouped.transformWithStateInPandas(dialogue, outputStructType=schema, outputMode="Append", timeMode="None" if time is None else "EventTime")
