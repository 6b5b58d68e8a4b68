"""Folds with feedback that windows can't express: a rate limit that records only admitted calls, and an LRU cache with a time to live."""
from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], limit: int, window: float = 60.0, recent: deque | None = None) -> tuple[list[bool], deque]:
    """Whether each call (seconds, ascending) is admitted: fewer than `limit` admitted ones in the `window` before it."""
    recent, out = recent if recent is not None else deque(), []
    for t in times:
        while recent and t - recent[0] >= window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def folded(rows: DataFrame, key: str, order: list[str], schema: str, start, step) -> DataFrame:
    """step(state, frame) -> frame over each key's rows in order, with a state that start() makes for each key.

    Rows come sorted and in batches, so a key with any number of rows costs time and not memory; a key is one sequence by nature.
    """
    def run(frames):
        current, state = None, None
        for pdf in frames:
            ends = [0, *((pdf[key] != pdf[key].shift()).to_numpy().nonzero()[0][1:]), len(pdf)] if len(pdf) else [0]
            for a, b in zip(ends, ends[1:]):
                part = pdf.iloc[a:b]
                if state is None or part[key].iloc[0] != current:
                    current, state = part[key].iloc[0], start()
                yield step(state, part)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(events: DataFrame, key: str, event_id: str, ts: str, limit: int, window: float = 60.0) -> DataFrame:
    """key, event_id, admitted. A fold per key in the order of time, then id. Rows without a key are dropped."""
    def step(recent: deque, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key], event_id: pdf[event_id], "admitted": admit(pdf["t"].tolist(), limit, window, recent)[0]})

    rows = events.selectExpr(key, event_id, f"unix_micros(cast({ts} as timestamp)) / 1e6 as t").where(f"{key} is not null")
    return folded(rows, key, ["t", event_id], f"{key} long, {event_id} long, admitted boolean", deque, step)


def cache_hits(keys: list[str], times: list[float], size: int, ttl: float, held: OrderedDict | None = None, ok: list[bool] | None = None) -> list[bool]:
    """Hits of a cache that holds `size` keys by last use; an entry ends `ttl` seconds after it was put, reads don't extend it. What isn't ok is not kept."""
    held = OrderedDict() if held is None else held
    out = []
    for k, t, good in zip(keys, times, ok or [True] * len(keys)):
        if k in held and t - held[k] <= ttl:
            held.move_to_end(k)
            out.append(True)
            continue
        out.append(False)
        held.pop(k, None)
        if not good:
            continue
        held[k] = t
        if len(held) > size:
            held.popitem(last=False)
    return out


def cache(events: DataFrame, group: str, event_id: str, ts: str, item: str, size: int, ttl: float) -> DataFrame:
    """group, event_id, hit: one cache per group, in the order of time, then id. Rows without a group are dropped."""
    def step(held: OrderedDict, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: pdf[group], event_id: pdf[event_id], "hit": cache_hits(pdf["item"].tolist(), pdf["t"].tolist(), size, ttl, held)})

    rows = events.selectExpr(group, event_id, f"{item} as item", f"unix_micros(cast({ts} as timestamp)) / 1e6 as t").where(f"{group} is not null")
    return folded(rows, group, ["t", event_id], f"{group} long, {event_id} long, hit boolean", OrderedDict, step)


def rate_limit_stream(events: DataFrame, key: str, event_id: str, limit: int, window: float = 60.0) -> DataFrame:
    """The rate limit over a stream with columns key, event_id and t (seconds); a micro-batch is folded in the order of t, then id."""
    def run(k, frames, state: GroupState):
        recent = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values(["t", event_id])
        ok, recent = admit(pdf["t"].tolist(), limit, window, recent)
        state.update((list(recent),))
        yield pd.DataFrame({key: pdf[key], event_id: pdf[event_id], "admitted": ok})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {event_id} long, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
