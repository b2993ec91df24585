"""Stateful processors: the ordered operators of the batch side over an unbounded input.

Every processor sorts the rows of its key within one micro-batch and keeps only what later rows need. State
lives in the state store, so a lost executor resumes from the last checkpoint.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.trailing import UNIT
from flowlens.schemas import MICROS

FEATURE_ROWS = ("src string, seq bigint, ts_us bigint, n bigint, event_rate double, byte_rate double, "
                "dest_port_entropy double, unique_dest_count double, avg_duration_ms double, same_dest_ratio double, "
                "late boolean, event_time timestamp")
WINDOW_ROWS = ("stream string, window_start bigint, window_end bigint, closed boolean, late boolean, src string, dst string, "
               "port int, flows bigint, bytes bigint, duration bigint")
FLAG_ROWS = "shard string, seq bigint, already_resolved boolean, breaker_tripped boolean"
VERDICT_ROWS = ("shard string, seq bigint, ts_us bigint, event_time timestamp, verdict_id string, window_id string, tier string, "
                "label string, confidence double, target string, on_allowlist boolean, late boolean, acts boolean")
FLOW_ROWS = ("flow_key string, start_us bigint, end_us bigint, source_ip string, source_port int, dest_ip string, dest_port int, "
             "packets bigint, total_bytes bigint, packets_fwd bigint, bytes_fwd bigint")

_BLOCK = ("src array<string>, ts_us array<bigint>, seq array<bigint>, dst array<string>, port array<int>, bytes array<bigint>, "
          "duration_ms array<bigint>")


def ordered(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(by), kind="stable")


#: How far behind its delay Spark's own watermark is held, so that late rows reach the processors that count them.
HORIZON_MS = 365 * 24 * 3600 * 1000


def own_watermark_us(timer_values) -> int | None:
    """The watermark of the stated delay, from one that is held back by the horizon; None before the first one."""
    held = timer_values.getCurrentWatermarkInMs()
    return (held + HORIZON_MS) * 1000 if held > 0 else None


def held_millis(us: int) -> int:
    """Timer time of an event time under the held-back watermark."""
    return max(millis(us) - HORIZON_MS, 1)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def millis(us: int) -> int:
    """Timer time: the first millisecond not before ``us``."""
    return -(-us // 1000)


def opt_int(value) -> int | None:
    return None if value is None or value != value else int(value)


def running(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums within the groups (numbers from 0), in the given order."""
    by = np.argsort(group, kind="stable")
    totals, opens = values[by].cumsum(), np.flatnonzero(np.diff(group[by], prepend=-1))
    before = np.concatenate([totals[:1] * 0, totals[opens[1:] - 1]])
    out = np.empty_like(totals)
    out[by] = totals - np.repeat(before, np.diff(opens, append=len(by)))
    return out


def trailing_totals(events: pd.DataFrame, window_us: int) -> dict[str, np.ndarray]:
    """What the inclusive trailing window of every event holds of its source, as the batch operator defines it.

    Events may be of many sources and in any order. As there, an event is an arrival and an expiry, and the totals run over
    those changes, so the work does not grow with what a window holds.
    """
    code = lambda c: pd.factorize(events[c], use_na_sentinel=False)[0].astype(np.int64)
    src, dst = code("src"), code("dst")
    port, _ = pd.factorize(events["port"])
    ts, seq, size, spent = (events[c].astype("int64").to_numpy() for c in ("ts_us", "seq", "bytes", "duration_ms"))
    if np.abs(size.astype(float)).sum() >= 2.0 ** 62:
        size = size.astype(object)  # sums that 64 bits may not hold
    sign, who = np.repeat(np.array([1, -1]), len(ts)), np.tile(np.arange(len(ts)), 2)
    order = np.lexsort((seq[who], sign < 0, np.concatenate([ts, ts + window_us]), src[who]))
    sign, who = sign[order], who[order]
    source, known = src[who], port[who] >= 0
    on_dest = running(sign, source * (dst.max() + 1) + dst[who])
    on_port = running(sign, source * (port.max() + 2) + port[who] + 1)
    # In whole units, so that what an arrival adds its expiry takes away to the last bit.
    weight = lambda c: np.rint(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)
    totals = {
        "n": running(sign, source), "bytes": running(sign * size[who], source), "spent": running(sign * spent[who], source),
        "dests": running(((sign > 0) & (on_dest == 1)) * 1 - ((sign < 0) & (on_dest == 0)), source),
        "ports": running(sign * known, source), "weight": running((weight(on_port) - weight(on_port - sign)) * known, source),
        "on_dest": on_dest}
    arrives = np.empty(len(ts), dtype=np.int64)
    arrives[who[sign > 0]] = np.flatnonzero(sign > 0)
    return {name: total[arrives] for name, total in totals.items()}


class TrailingFeatures(StatefulProcessor):
    """Trailing window per source; rows behind the watermark come out marked ``late``, without features.

    Key: anything that keeps a source together. Most sources send few events in a batch, so a key per source would be mostly
    calls, frames and state lookups; the sources of a key are swept at once.

    State: a ring of time buckets, each an appended list of blocks of its events. A batch writes its own events and nothing
    else: it appends to the bucket it continues, starts the buckets it opens and clears those that no window reaches any more,
    not even that of a row which comes ``delay_us`` behind the newest.
    """

    #: Buckets of the ring; what is kept touches one fewer than this at most.
    SLOTS = 6
    #: Events of a row of state at most.
    BLOCK = 1_000
    #: Stands for the bucket of a slot that holds none.
    EMPTY = -(1 << 62)

    def __init__(self, window_us: int, delay_us: int = 0) -> None:
        self.window_us = window_us
        # The watermark is cut to milliseconds.
        self.kept_us = window_us + delay_us + 1000
        self.bucket_us = -(-self.kept_us // (self.SLOTS - 2))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "buckets array<bigint>")
        self.ring = [handle.getListState(f"bucket{i}", _BLOCK) for i in range(self.SLOTS)]

    def load(self) -> tuple[list[int], pd.DataFrame]:
        """Bucket numbers of the slots and the stored events."""
        held = [int(b) for b in self.held.get()[0]] if self.held.exists() else [self.EMPTY] * self.SLOTS
        blocks = [block for slot, b in enumerate(held) if b != self.EMPTY for block in self.ring[slot].get()]
        events = pd.DataFrame({c: [v for block in blocks for v in block[i]] for i, c in enumerate(names(_BLOCK))})
        return held, events.astype({"port": "Float64"})

    def blocks(self, events: pd.DataFrame) -> list[tuple]:
        ports = [opt_int(p) for p in events["port"].to_numpy(dtype=float, na_value=np.nan)]
        plain = [ports if c == "port" else events[c].tolist() for c in names(_BLOCK)]
        return [tuple(values[low:low + self.BLOCK] for values in plain) for low in range(0, len(events), self.BLOCK)]

    def save(self, held: list[int], new: pd.DataFrame, newest: int) -> None:
        oldest, bucket = (newest - self.kept_us) // self.bucket_us, new["ts_us"] // self.bucket_us
        fresh = {int(b): self.blocks(events) for b, events in new[bucket >= oldest].groupby(bucket)}
        for slot in range(self.SLOTS):
            if held[slot] != self.EMPTY and held[slot] < oldest and not any(b % self.SLOTS == slot for b in fresh):
                self.ring[slot].clear()
                held[slot] = self.EMPTY
        for b, blocks in fresh.items():
            slot = b % self.SLOTS
            if held[slot] == b:
                self.ring[slot].appendList(blocks)
            else:
                self.ring[slot].put(blocks)
                held[slot] = b
        self.held.update((held,))

    def handleInputRows(self, key, rows, timerValues):
        frame, bar = ordered(rows, "ts_us", "seq"), own_watermark_us(timerValues)
        behind = frame["ts_us"] < bar if bar is not None else frame["ts_us"] != frame["ts_us"]
        late, frame = frame[behind], frame[~behind]
        if len(late):
            yield pd.DataFrame({c: (late[c] if c in ("src", "seq", "ts_us", "event_time") else True if c == "late" else None)
                                for c in names(FEATURE_ROWS)}, index=late.index).astype({"n": "Int64"})
        if not len(frame):
            return
        held, past = self.load()
        new = frame[names(_BLOCK)].astype({"port": "Float64"})
        events = pd.concat([past, new], ignore_index=True) if len(past) else new
        newest = int(events["ts_us"].max())
        of = {name: total[len(past):] for name, total in trailing_totals(events, self.window_us).items()}
        self.save(held, new, newest)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
        self.handle.registerTimer(held_millis(newest + self.kept_us) + 1)
        n, ports, span = of["n"], np.maximum(of["ports"], 1), self.window_us / MICROS
        yield pd.DataFrame({
            "src": new["src"], "seq": new["seq"].astype("int64"), "ts_us": new["ts_us"].astype("int64"), "n": n, "event_rate": n / span,
            "byte_rate": (of["bytes"] / span).astype(float),
            "dest_port_entropy": np.maximum(np.log2(ports) - of["weight"] / UNIT / ports, 0.0),
            "unique_dest_count": of["dests"].astype(float), "avg_duration_ms": of["spent"] / n, "same_dest_ratio": of["on_dest"] / n,
            "late": False, "event_time": frame["event_time"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Nothing of the key's sources can be in a window any more."""
        for slot in self.ring:
            slot.clear()
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class AnchoredWindows(StatefulProcessor):
    """Anchored windows per stream. State: the open window's start and its counts per host pair and port.

    Of a batch only numbers are held, names as codes; closed windows leave as soon as they fill a frame.
    """

    #: Rows of a frame that goes out.
    FRAME = 10_000

    def __init__(self, width_us: int, grace_us: int = 0) -> None:
        self.width_us = width_us
        self.grace_us = grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "window_start bigint")
        self.counts = handle.getMapState("counts", "src string, dst string, port int", "flows bigint, bytes bigint, duration bigint")

    def rows_of(self, key, start, end, closed, late, counts):
        return [(key[0], start, end, closed, late, s, d, None if p == -1 else p, *v) for (s, d, p), v in counts.items()]

    def arrays(self, frames: Iterator[pd.DataFrame]) -> tuple[list[np.ndarray], list]:
        """Time, source, target, port (-1: none), bytes and duration in order of time and arrival, and the names behind the codes."""
        names, pieces = {}, []
        for frame in frames:
            coded = [np.array([names.setdefault(n, len(names)) for n in frame[c]], dtype=np.int32) for c in ("src", "dst")]
            port = frame["port"].astype("Float64").fillna(-1).to_numpy(dtype=np.int32)
            numbers = [values.to_numpy(dtype=np.int64) for values in (
                frame["ts_us"], frame["seq"].fillna(0), frame["bytes"], frame["duration_ms"])]
            pieces.append((numbers[0], numbers[1], *coded, port, *numbers[2:]))
        columns = [np.concatenate(c) for c in zip(*pieces)]
        pieces.clear()
        order = np.lexsort((columns[1], columns[0]))
        return [c[order] for i, c in enumerate(columns) if i != 1], list(names)

    def made(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names(WINDOW_ROWS)).astype({"port": "Int32", "window_start": "Int64", "window_end": "Int64"})

    def handleInputRows(self, key, rows, timerValues):
        bar = own_watermark_us(timerValues)
        start = opened = self.start.get()[0] if self.start.exists() else None
        counts = {tuple(k): list(v) for k, v in self.counts.iterator()} if start is not None else {}
        out, late, touched = [], {}, set()
        columns, known = self.arrays(rows)
        for low in range(0, len(columns[0]), self.FRAME):
            for ts, src, dst, port, size, duration in zip(*[c[low:low + self.FRAME].tolist() for c in columns]):
                group = (known[src], known[dst], port)
                if (bar is not None and ts < bar) or (start is not None and ts < start):
                    into = late  # its window is closed; reported, never mixed into the open one
                else:
                    if start is None or ts - start >= self.width_us:
                        if start is not None:
                            out += self.rows_of(key, start, ts, True, False, counts)
                        start, counts, touched = ts, {}, set()
                    into = counts
                    touched.add(group)
                cell = into.setdefault(group, [0, 0, 0])
                cell[0] += 1
                cell[1] += size
                cell[2] += duration
            if len(out) >= self.FRAME:
                yield self.made(out)
                out = []
        out += self.rows_of(key, None, None, True, True, late)
        if touched:
            self.save(start, opened, counts, touched)
        yield self.made(out)

    def save(self, start, opened, counts, touched):
        """Writes the cells that the batch has changed; a new window drops those of the one before."""
        if start != opened:
            self.start.update((start,))
            self.counts.clear()
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
            self.handle.registerTimer(held_millis(start + self.width_us + self.grace_us))
        for group in touched:
            self.counts.updateValue(group, tuple(counts[group]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """No event closed the window in time: flush it at its full width."""
        start = self.start.get()[0]
        counts = {tuple(k): list(v) for k, v in self.counts.iterator()}
        self.start.clear()
        self.counts.clear()
        yield pd.DataFrame(self.rows_of(key, start, start + self.width_us, False, False, counts),
                           columns=[c.split()[0] for c in WINDOW_ROWS.split(", ")]).astype({"port": "Int32"})

    def close(self) -> None:
        pass


class DecisionGate(StatefulProcessor):
    """First action per window and action cap per shard; the policy table itself stays an expression.

    State: resolved window ids (forgotten ``ttl_us`` after they acted, if that is given) and the times of at most ``cap``
    blocks. Verdicts of a batch are taken in order of time, then arrival, as in the batch rule.
    """

    def __init__(self, cap: int, window_us: int, ttl_us: int | None) -> None:
        self.cap = cap
        self.window_us = window_us
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.resolved = handle.getMapState("resolved", "window_id string", "ts_us bigint")
        self.taken = handle.getListState("taken", "ts_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        taken = deque(r[0] for r in self.taken.get())
        out, newest = [], None
        frame = ordered(rows, "ts_us", "seq")
        for seq, ts, window, acts, exempt in zip(*[frame[c] for c in ("seq", "ts_us", "window_id", "acts", "on_allowlist")]):
            done = bool(self.resolved.containsKey((window,))) if window is not None else False
            tripped = False
            if acts and not done:
                self.resolved.updateValue((window,), (int(ts),))
                newest = int(ts)
                if not exempt:
                    while taken and ts - taken[0] > self.window_us:
                        taken.popleft()
                    tripped = len(taken) >= self.cap
                    if not tripped:
                        taken.append(int(ts))
            out.append((key[0], int(seq), done, tripped))
        self.taken.put([(t,) for t in taken])
        if self.ttl_us is not None and newest is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(millis(newest + self.ttl_us))
        yield pd.DataFrame(out, columns=["shard", "seq", "already_resolved", "breaker_tripped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forgets windows that are too old to come back."""
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.ttl_us
        kept = [(w[0], t[0]) for w, t in self.resolved.iterator()]
        for window, ts in kept:
            if ts <= limit:
                self.resolved.removeKey((window,))
        newer = [ts for _, ts in kept if ts > limit]
        if newer:
            self.handle.registerTimer(millis(min(newer) + self.ttl_us))
        yield from ()

    def close(self) -> None:
        pass


class FirstAction(StatefulProcessor):
    """Marks the verdicts of a window after the first one that acts. Key: shard and window; state: that one's time.

    A window is a row of state of its own, so a shard with a million windows has a million small rows and no large one.
    """

    def __init__(self, ttl_us: int | None = None) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ts_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame, done = ordered(rows, "ts_us", "seq"), self.first.exists()
        acts = frame["acts"].to_numpy(dtype=bool)
        before = acts.cumsum() - acts > 0
        if acts.any() and not done:
            first = int(frame["ts_us"].to_numpy()[acts.argmax()])
            self.first.update((first,))
            if self.ttl_us is not None:
                self.handle.registerTimer(held_millis(first + self.ttl_us))
        yield frame[names(VERDICT_ROWS)].assign(already_resolved=before | done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Too old for another verdict of the window to come."""
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


class FirstActions(FirstAction):
    """``FirstAction`` for all windows of a shard's slot at once. Key: shard and slot; state: a row per window that acted.

    Most windows hold one verdict, so a key per window would cost a call, a frame and a state lookup per verdict. What is
    looked up here is the smaller of the batch's windows and the stored ones.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "window_id string", "ts_us bigint")
        self.held = handle.getValueState("held", "windows bigint")

    def stored(self, found: list[str], held: int) -> np.ndarray:
        """Which of the windows have acted in an earlier batch."""
        if not held:
            return np.zeros(len(found), dtype=bool)
        if held < len(found):
            known = {k[0] for k in self.first.keys()}
            return np.array([w in known for w in found], dtype=bool)
        return np.array([self.first.containsKey((w,)) for w in found], dtype=bool)

    def handleInputRows(self, key, rows, timerValues):
        frame = ordered(rows, "ts_us", "seq")
        # A verdict without a window shares one with the others that have none.
        codes, found = pd.factorize(np.array(["-" if w is None or w != w else f"+{w}" for w in frame["window_id"]], dtype=object))
        held = self.held.get()[0] if self.held.exists() else 0
        done = self.stored(list(found), held)
        acts, ts = frame["acts"].to_numpy(dtype=bool), frame["ts_us"].to_numpy()
        before = pd.Series(acts.astype(np.int64)).groupby(codes).cumsum().to_numpy() - acts > 0
        acting = np.flatnonzero(acts)
        window, first = np.unique(codes[acting], return_index=True)
        new = [(str(found[w]), int(ts[acting[i]])) for w, i in zip(window, first) if not done[w]]
        for name, at in new:
            self.first.updateValue((name,), (at,))
        if new:
            self.held.update((held + len(new),))
            if self.ttl_us is not None and not any(True for _ in self.handle.listTimers()):
                self.handle.registerTimer(held_millis(min(at for _, at in new) + self.ttl_us))
        yield frame[names(VERDICT_ROWS)].assign(already_resolved=before | done[codes])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forgets the windows of which no other verdict can come."""
        limit = (expiredTimerInfo.getExpiryTimeInMs() + HORIZON_MS) * 1000 - self.ttl_us
        kept = [(w[0], t[0]) for w, t in self.first.iterator()]
        newer = [at for _, at in kept if at > limit]
        for window, at in kept:
            if at <= limit:
                self.first.removeKey((window,))
        self.held.update((len(newer),))
        if newer:
            self.handle.registerTimer(held_millis(min(newer) + self.ttl_us))
        yield from ()


class ActionCap(StatefulProcessor):
    """Caps the candidates of a shard. Key: the shard for candidates, anything that spreads them for other verdicts.

    State: the times of at most ``cap`` blocks of a shard; verdicts that ask for no block pass without state.
    """

    def __init__(self, cap: int, window_us: int) -> None:
        self.cap = cap
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "ts_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = ordered(rows, "ts_us", "seq")
        columns = [*names(VERDICT_ROWS), "already_resolved"]
        if not frame["asks"].iloc[0]:
            yield frame[columns].assign(breaker_tripped=False)
            return
        taken, tripped = deque(r[0] for r in self.taken.get()), []
        for ts in frame["ts_us"].tolist():
            while taken and ts - taken[0] > self.window_us:
                taken.popleft()
            tripped.append(len(taken) >= self.cap)
            if not tripped[-1]:
                taken.append(ts)
        self.taken.put([(t,) for t in taken])
        yield frame[columns].assign(breaker_tripped=tripped)

    def close(self) -> None:
        pass


class OpenFlow(StatefulProcessor):
    """Flow assembly per 5-tuple and capture. State: the open flow's sums; an event-time timer ends an idle flow."""

    def __init__(self, idle_us: int, active_us: int) -> None:
        self.idle_us = idle_us
        self.active_us = active_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState(
            "open", "start_us bigint, end_us bigint, source_ip string, source_port int, dest_ip string, dest_port int, "
            "packets bigint, total_bytes bigint, packets_fwd bigint, bytes_fwd bigint")

    def frame(self, key, flows):
        out = pd.DataFrame([(key[0], *f) for f in flows], columns=[c.split()[0] for c in FLOW_ROWS.split(", ")])
        return out.astype({"source_port": "Int32", "dest_port": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        flow = list(self.open.get()) if self.open.exists() else None
        done = []
        frame = ordered(rows, "ts_us", "seq")
        for ts, a, ap, b, bp, size in zip(*[frame[c] for c in ("ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "length")]):
            ts, ap, bp, size = int(ts), opt_int(ap), opt_int(bp), int(size)
            if flow is not None and (ts - flow[1] > self.idle_us or ts - flow[0] > self.active_us):
                done.append(flow)
                flow = None
            if flow is None:
                flow = [ts, ts, a, ap, b, bp, 0, 0, 0, 0]
            flow[1], flow[6], flow[7] = ts, flow[6] + 1, flow[7] + size
            if (a, ap) == (flow[2], opt_int(flow[3])):
                flow[8], flow[9] = flow[8] + 1, flow[9] + size
        self.open.update(tuple(flow))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
        self.handle.registerTimer(millis(flow[1] + self.idle_us) + 1)
        yield self.frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        flow = self.open.get()
        self.open.clear()
        yield self.frame(key, [flow])

    def close(self) -> None:
        pass
