"""Answers of open attempts as state: each batch touches the attempts it has events of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Fields of an answer that events may set.
FIELDS = {"selected_option": IntegerType(), "numerical_answer": DoubleType(), "text_answer": StringType(), "time_spent": LongType()}
EVENT = StructType([StructField("attempt", LongType()), StructField("question", LongType()), StructField("seq", LongType()), StructField("given", ArrayType(StringType())), *(StructField(n, t) for n, t in FIELDS.items())])
ANSWER = StructType([StructField("attempt", LongType()), StructField("question", LongType()), StructField("seq", LongType()), *(StructField(n, t) for n, t in FIELDS.items())])
_KEY = StructType([StructField("question", LongType())])
#: A field and the event that set it last.
_HELD = StructType([f for n, t in FIELDS.items() for f in (StructField(n, t), StructField(f"{n}_seq", LongType()))])
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Answers(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("answers", _KEY, _HELD, self.keep)

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        changed: dict[int, dict] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                q = int(row.question)
                if q not in changed:
                    old = self.held.getValue((q,)) if self.held.containsKey((q,)) else (None,) * len(_HELD)
                    changed[q] = dict(zip(_HELD.names, old))
                now = changed[q]
                for f in row.given if row.given is not None else ():
                    seq = now.get(f"{f}_seq")
                    if f in FIELDS and (seq is None or row.seq >= seq):
                        now[f], now[f"{f}_seq"] = _plain(getattr(row, f), FIELDS[f]), int(row.seq)
        out = []
        for q, now in sorted(changed.items()):
            self.held.updateValue((q,), tuple(now[n] for n in _HELD.names))
            seqs = [now[f"{f}_seq"] for f in FIELDS if now[f"{f}_seq"] is not None]
            out.append((key[0], q, max(seqs, default=None), *(now[f] for f in FIELDS)))
        frame = pd.DataFrame(out, columns=ANSWER.names, dtype=object)
        yield frame

    def close(self) -> None:
        pass


def _plain(value, kind):
    """A value of a batch as state keeps it; what pandas shows as missing is null."""
    if value is None or value != value:
        return None
    return {IntegerType: int, LongType: int, DoubleType: float, StringType: str}[type(kind)](value)


def current_answers(events: DataFrame, keep: str | None = None) -> DataFrame:
    """Answers as they are after each batch, of the questions that it changed: attempt, question,
    seq, and the fields.

    events: EVENT.  Each field has the value of the latest event by seq that gives it, null too;
    an event that comes late, or again, changes only what no later one gave; events of equal seq
    go by arrival.  Unknown fields and rows without attempt or question are left out.  State is
    kept by attempt and question, for `keep` after its last change if given.  The session needs
    the settings in STORE.
    """
    ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    good = events.where("attempt is not null and question is not null and seq is not null")
    # Numbers that may be missing come as doubles to Python; longs of state keep theirs.
    rows = good.select(*(F.col(f.name) for f in EVENT))
    mode = "ProcessingTime" if keep else "None"
    return rows.groupBy("attempt").transformWithStateInPandas(_Answers(ms), ANSWER, "Update", mode)


def folded_answers(events: DataFrame) -> DataFrame:
    """The same for a table of events: attempt, question, seq, and the fields."""
    good = events.where("attempt is not null and question is not null and seq is not null")
    has = lambda n: F.array_contains(F.coalesce("given", F.array().cast("array<string>")), n)
    value = lambda n: F.max_by(F.struct(n), F.when(has(n), F.col("seq")))[n].alias(n)
    seq = F.max(F.when(F.exists(F.coalesce("given", F.array().cast("array<string>")), lambda g: g.isin(*FIELDS)), F.col("seq"))).alias("seq")
    return good.groupBy("attempt", "question").agg(seq, *map(value, FIELDS))
