"""Questions that wait for a fact: open needs as state by conversation.

What a turn says is read by column expressions before anything is keyed: whether it is
about unemployment, the days that it states, and what it would mean as a reply. The state
of a conversation is which fact was asked for and which are known; a reply resumes the
decision where it stopped, and a conversation that is silent for longer than ``stale``
seconds starts anew. The rule itself is again columns, over what the state gave.

``replayed`` does the same over a finished table; a stream in any batches gives its rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators import rules as R

#: A question is forgotten after so many seconds without a turn.
STALE = 14 * 24 * 3600
STATE = "active boolean, asked string, days string, stem string, last long"
FACTS = "conv_id long, turn long, days string, stem string"


def read(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, ts, about, stated, as_days, as_stem) of what users say in ``turns`` (conv_id, turn, role, text, ts)."""
    text = F.coalesce("text", F.lit(""))
    said = R.said_numbers(text)
    about = F.lower(text).contains("unemploy")
    stated = F.when(about & (F.size(said) > 0), F.array_join(F.transform(F.array_sort(said), R.general), ","))
    as_fact = lambda fact: R.reply_value(F.lit(fact), text)
    x = turns.where("role = 'user' and conv_id is not null and turn is not null")
    return x.select("conv_id", "turn", F.col("ts").cast("timestamp").alias("ts"), about.alias("about"), stated.alias("stated"), as_fact("unemployment_days").alias("as_days"), as_fact("stem_extension").alias("as_stem"))


def step(state: tuple, row, at: int) -> tuple[tuple, tuple | None]:
    """The state after one turn at second ``at``, and the facts (days, stem) if the rule is in play."""
    active, asked, days, stem, last = state
    if at - last > STALE:
        active, asked, days, stem = False, None, None, None
    if asked == "unemployment_days":
        days = row.as_days or days
    elif asked == "stem_extension":
        stem = row.as_stem or stem
    if row.about:
        active, days = True, row.stated or days
    if not active:
        return (False, None, days, stem, at), None
    asked = "unemployment_days" if not days else "stem_extension" if not stem else None
    # a decided question is no longer open; what was said about the person stays known
    return (asked is not None, asked, days, stem, at), (days, stem)


def _follow(rows: list, state: tuple) -> tuple[list[tuple], tuple]:
    out = []
    for r in sorted(rows, key=lambda r: r.turn):
        state, facts = step(state, r, r.ts.value // 10**9)
        if facts:
            out.append((r.conv_id, r.turn, *facts))
    return out, state


_NEW = (False, None, None, None, 0)
_COLUMNS = ["conv_id", "turn", "days", "stem"]


def _tuples(pdf: pd.DataFrame) -> list:
    pdf = pdf.astype(object).where(pdf.notna(), None).assign(ts=pdf["ts"])
    return list(pdf.itertuples(index=False))


def _decided(facts: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, fact, decision) of facts (conv_id, turn, days, stem)."""
    days = F.transform(F.split("days", ","), lambda d: d.cast("double"))
    result: Column = R.unemployment(F.lit(True), F.when(F.col("days").isNotNull(), days), F.col("stem") == "true")
    return facts.select("conv_id", "turn", result.alias("r")).select("conv_id", "turn", "r.kind", "r.fact", "r.decision")


def waiting(turns: DataFrame, late: str = "1 day") -> DataFrame:
    """Decisions and open questions, turn by turn, of a stream of ``turns``; a batch holds a
    conversation's turns in order, and so do batches one after the other."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for pdf in batches for r in _tuples(pdf)]
        out, after = _follow(rows, state.get if state.exists else _NEW)
        state.update(after)
        state.setTimeoutTimestamp(max(after[4] + STALE, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    x = read(turns).withWatermark("ts", late).groupBy("conv_id")
    return _decided(x.applyInPandasWithState(run, FACTS, STATE, "append", GroupStateTimeout.EventTimeTimeout))


_UNTIMED = pd.NaT.value // 10**9
_Turn = namedtuple("_Turn", "conv_id turn at about stated as_days as_stem")


def replayed(turns: DataFrame) -> DataFrame:
    """The rows of ``waiting`` over a table. Conversations are dealt out and sorted; a task walks
    over its turns in batches and holds one state, however many conversations or turns there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, _NEW
        for b in batches:
            out = []
            for r in map(_Turn._make, zip(*(b.column(c).to_pylist() for c in _Turn._fields))):
                if r.conv_id != conv:
                    conv, state = r.conv_id, _NEW
                state, facts = step(state, r, r.at)
                if facts:
                    out.append((r.conv_id, r.turn, *facts))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names=_COLUMNS)

    x = read(turns).withColumn("at", F.coalesce(F.unix_seconds("ts"), F.lit(_UNTIMED))).select(*_Turn._fields)
    x = x.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *_Turn._fields[2:])
    return _decided(x.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, FACTS))
