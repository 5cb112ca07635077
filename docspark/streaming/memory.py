"""Short-term memory as a stateful stream: messages per conversation, cut back when they are too many or too long, gone when idle.

The messages that are held are a list state, the time of the last one is a value state. A timer, set anew with each message, ends a
conversation once nothing was said for the idle time. With processing time, both states also expire by themselves; with event time, the
clock is the watermark, and a message that comes that late begins a new session whether the timer has fired before it or not.
What memory held when it was cut back or ended is a snapshot, from which facts are drawn, merged and stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators import memory
from ..operators.shared import kept
from ..operators.versions import VersionedTables

OUT = "conv_id long, turn long, kept int, compacted boolean, ended boolean, snapshot string"


class ShortMemory(StatefulProcessor):
    """State is the messages that are held, so it is bounded by the caps on their number and length."""

    def __init__(self, settings: Settings, event_time: bool):
        self.settings, self.event_time = settings, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else self.settings.idle_seconds * 2000  # later than the timer, which needs what is held
        self.held = handle.getListState("held", "line string, length int", ttl)
        self.last = handle.getValueState("last", "ms long", ttl)

    def _end(self, key: tuple, turn: int | None = None) -> tuple:
        snapshot = "\n".join(x[0] for x in self.held.get())
        self.held.clear()
        self.last.clear()
        return key[0], turn, 0, False, True, snapshot

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, idle = self.settings, self.settings.idle_seconds * 1000
        now = timerValues.getCurrentProcessingTimeInMs()
        frame = pd.concat(list(rows)).sort_values("turn")
        held = [(x[0], x[1]) for x in self.held.get()] if self.held.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out, before = [], last
        for turn, role, text, ms in frame[["turn", "role", "text", "ms"]].itertuples(index=False):
            at = int(ms) if self.event_time else now
            if last is not None and at - last >= idle:
                out.append((key[0], None, 0, False, True, "\n".join(x for x, _ in held)))
                held = []
            last = at
            held.append((f"{(role or '').capitalize()}: {text or ''}", len(text or "")))
            cut = len(held) > s.compact_messages or sum(n for _, n in held) > s.compact_chars
            snapshot = "\n".join(x for x, _ in held) if cut else None
            held = held[-s.keep_messages :] if cut else held
            out.append((key[0], turn, len(held), cut, False, snapshot))
        self.held.put(held)
        self.last.update((last,))
        if before is not None:
            self.handle.deleteTimer(before + idle)
        self.handle.registerTimer(last + idle)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"turn": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        if last is None or last + self.settings.idle_seconds * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([self._end(key)], columns=[x.split()[0] for x in OUT.split(", ")]).astype({"turn": "Int64"})

    def close(self) -> None:
        pass


def compacted(messages: DataFrame, settings: Settings = DEFAULTS, event_time: str | None = None) -> DataFrame:
    """A row per message (conv_id, turn, role, text[, ``event_time``]): how many messages memory holds after it, whether it was cut back,
    and the snapshot if so; and a row with ``ended`` and the last snapshot for each conversation that was idle.

    ``event_time`` names a timestamp column with a watermark. The session needs the state store that
    ``session.create_session`` sets.
    """
    ms = F.unix_millis(F.col(event_time)) if event_time else F.lit(0).cast("long")
    columns = ["conv_id", "turn", "role", "text", ms.alias("ms"), *([event_time] if event_time else [])]
    mode = "EventTime" if event_time else "ProcessingTime"
    return messages.select(*columns).groupBy("conv_id").transformWithStateInPandas(ShortMemory(settings, event_time is not None), OUT, "append", mode)


def remembered(rows: DataFrame, facts: VersionedTables, extract: Callable[[str], str], checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Facts of the snapshots of ``compacted`` rows, merged into the table ``facts`` (``memory.FACTS``), each batch once.

    The table and its ledger change together: a batch that is run again finds its number there and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if facts.has_batch(checkpoint, number):
            return
        told = batch.where("snapshot is not null").select(F.col("conv_id").cast("string").alias("conversation_id"), "snapshot")
        said = kept(memory.facts_of(told, extract, "conversation_id").withColumn("order", F.monotonically_increasing_id()))
        place = F.row_number().over(memory.Window.partitionBy("conversation_id").orderBy("order")) - 1
        incoming = said.withColumns({"pos": place.cast("int"), "updated_at": F.current_timestamp()}).drop("order")
        memory.remember(facts, incoming, None, settings, (checkpoint, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
