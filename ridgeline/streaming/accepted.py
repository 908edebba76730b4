"""Accepted fixes of recordings that arrive in pieces: the acceptance pass as a stateful operator of Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .. import config as C
from ..operators import points as P

_FIX = ["track", "segment", "latitude", "longitude", "ms", "elevation"]
#: The typed state of a track: where it is, its anchor and pending fix, and its running sums.
_STATE = StructType(
    [
        StructField("position", LongType()),
        StructField("first_ms", LongType()),
        StructField("early", BooleanType()),
        StructField("cumulative_m", DoubleType()),
        StructField("moving_ms", LongType()),
        StructField("track", LongType()),
        StructField("segment", LongType()),
        *[StructField(f"{which}_{name}", DoubleType()) for which in ("anchor", "pending") for name in _FIX],
    ]
)
_ADDED = [("gps_warmup", "boolean"), *((name, kind) for name, _, kind in P._PASS), ("cumulative_m", "double"), ("moving_ms", "bigint")]


def _fix(fix: tuple | None) -> list[float | None]:
    """A fix as the state's columns; one without elevation has a null there, none at all has nulls throughout."""
    if fix is None:
        return [None] * len(_FIX)
    (_, track, segment), *rest = fix
    return [float(track), float(segment), *(None if np.isnan(x) else float(x) for x in rest)]


def _of_state(key: str, columns: list[float | None]) -> tuple | None:
    if columns[0] is None:
        return None
    return ((key, int(columns[0]), int(columns[1])), *(np.nan if x is None else x for x in columns[2:]))


def _warmed(rows: pd.DataFrame, first_ms: int | None) -> np.ndarray:
    """``gps_warmup`` of the rows of one segment from its start on: those before the last implausible step of the first minute."""
    ms, lat, lon, at = rows["at_ms"].to_numpy(float), rows["latitude"].to_numpy(float), rows["longitude"].to_numpy(float), rows["position"].to_numpy()
    if first_ms is None or not len(rows):
        return np.zeros(len(rows), dtype=bool)
    step = np.full(len(rows), np.nan)
    seconds = np.diff(ms) / 1000
    np.divide(P._distance(lat[:-1], lon[:-1], lat[1:], lon[1:]), seconds, out=step[1:], where=seconds > 0)
    cut = at[(ms - first_ms <= C.GPS_WARMUP_MS) & (step > C.MAX_PLAUSIBLE_MPS)]
    return at < cut.max() if len(cut) else np.zeros(len(rows), dtype=bool)


class AcceptedFixes(StatefulProcessor):
    """Holds back the first minute of a segment, as its warm-up is known only then; the rest goes out with the batch it came in."""

    def __init__(self, columns: list[str], held: str, idle_ms: int):
        self.columns, self.held_schema, self.idle_ms = columns, held, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", _STATE)
        self.early = handle.getListState("early", self.held_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("position", kind="stable")
        state = dict(zip(_STATE.names, self.at.get(), strict=True)) if self.at.exists() else None
        if state is not None:
            new = new[new["position"] > state["position"]]
        new = new.drop_duplicates("position")
        if len(new):
            yield from self._advance(key[0], state, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.at.exists():
            state = dict(zip(_STATE.names, self.at.get(), strict=True))
            held = self._held()
            if len(held):
                yield self._out(key[0], state, held, _warmed(held, state["first_ms"]))
        self.early.clear()
        self.at.clear()

    def _held(self) -> pd.DataFrame:
        found = pd.DataFrame(list(self.early.get()) if self.early.exists() else [], columns=self.columns)
        return found.astype({c: "float64" for c in ("latitude", "longitude", "elevation_m")})

    def _advance(self, key: str, state: dict | None, new: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state = state or dict.fromkeys(_STATE.names)
        rows = pd.concat([self._held(), new[self.columns]], ignore_index=True) if state["early"] else new[self.columns].reset_index(drop=True)
        parts = rows.groupby(((rows["track_position"].diff() != 0) | (rows["segment_position"].diff() != 0)).cumsum(), sort=False)
        segments = [part for _, part in parts]
        for k, part in enumerate(segments):
            last = k == len(segments) - 1
            same = k == 0 and state["track"] == int(part["track_position"].iloc[0]) and state["segment"] == int(part["segment_position"].iloc[0])
            if not same:
                start = part["at_ms"].iloc[0]
                state |= {"track": int(part["track_position"].iloc[0]), "segment": int(part["segment_position"].iloc[0]), "first_ms": None if pd.isna(start) else int(start), "early": not pd.isna(start)}
            if state["early"]:
                if last and not (part["at_ms"].to_numpy(float) - state["first_ms"] > C.GPS_WARMUP_MS).any():
                    break  # still in its first minute
                warm = _warmed(part, state["first_ms"])
                state["early"] = False
            else:
                warm = np.zeros(len(part), dtype=bool)
            yield self._out(key, state, part, warm)
            segments[k] = part.iloc[:0]
        self.early.clear()
        if state["early"]:
            self.early.put([tuple(None if pd.isna(x) else x for x in r) for r in segments[-1].astype(object).itertuples(index=False)])
        state["position"] = int(rows["position"].iloc[-1])
        self.at.update(tuple(state[n] for n in _STATE.names))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        newest = rows["at_ms"].max()
        if not pd.isna(newest):
            self.handle.registerTimer(int(newest) + self.idle_ms)

    def _out(self, key: str, state: dict, rows: pd.DataFrame, warm: np.ndarray) -> pd.DataFrame:
        """The rows with what the pass adds; moves the state's anchor, pending fix and sums on."""
        columns = {which: [f"{which}_{name}" for name in _FIX] for which in ("anchor", "pending")}
        held = P.Acceptance(*(_of_state(key, [state[c] for c in columns[which]]) for which in ("anchor", "pending")))
        sent = rows.assign(track_id=key, gps_warmup=warm)
        batch = pa.RecordBatch.from_pandas(sent[["track_id", "track_position", "segment_position", "latitude", "longitude", "elevation_m", "at_ms", "gps_warmup"]].rename(columns={"at_ms": "_ms"}), preserve_index=False)
        found = held.run(batch).to_pandas()
        for which, fix in (("anchor", held.anchor), ("pending", held.pending)):
            state |= dict(zip(columns[which], _fix(fix), strict=True))
        out = sent.reset_index(drop=True).assign(**{name: found[name] for name, *_ in P._PASS})
        credit = np.where(out["valid"], out["gps_delta_m"], 0.0)
        ms = np.where(out["valid"], out["gps_delta_ms"].astype(float), np.nan)
        moving = np.zeros(len(out), dtype=np.int64)
        some = ms > 0
        moving[some] = np.where(credit[some] / (ms[some] / 1000) >= C.MOVING_MPS, ms[some], 0)
        out["cumulative_m"] = np.cumsum(np.concatenate([[state["cumulative_m"] or 0.0], credit]))[1:]
        out["moving_ms"] = moving
        state["cumulative_m"] = float(out["cumulative_m"].iloc[-1])
        state["moving_ms"] = int((state["moving_ms"] or 0) + moving.sum())
        return out


def accepted_fixes(stream: DataFrame, late: str = "60 seconds", idle: str = "2 hours") -> DataFrame:
    """A stream of points with ``gps_warmup, valid, derived_speed_mps, gps_delta_m, gps_delta_ms, gain_m, loss_m``, and by GPS ``cumulative_m`` and ``moving_ms``.

    What the batch pass gives, however a track is cut into arrivals.  A track's points come in order of position from
    one micro-batch to the next, in any order inside one; a point not beyond the last one of earlier micro-batches is
    left out, as are those ``late`` behind the newest.  A track ends when the watermark is ``idle`` beyond its newest
    point: what is held back goes out and its state is dropped.  Times don't go back inside a segment.

    Python's stateful operators need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
    """
    timed = stream.withWatermark("recorded_at", late).withColumn("at_ms", F.unix_millis("recorded_at"))
    kept = [f for f in timed.schema.fields if f.name != "track_id"]
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    added = ", ".join(f"{name} {kind}" for name, kind in _ADDED)
    out = f"track_id {dict(timed.dtypes)['track_id']}, {held}, {added}"
    found = timed.groupBy("track_id").transformWithStateInPandas(AcceptedFixes([f.name for f in kept], held, idle_ms), out, "Append", "EventTime")
    return found.drop("at_ms")
