"""Ordered folds as machines whose steps compose: feedback scores, recovery pairs, token buckets."""

from __future__ import annotations

import json
import math
from bisect import bisect_right

import numpy as np


class Table:
    """A machine of numbered states: ``steps[code][state]`` is the next state, ``tells[code][state]`` what a row gets.

    A run's transition is a table over all states. States that have met are carried on as one; of most
    machines few are left after some dozen rows.
    """

    outputs = "told long"

    def __init__(self, steps: np.ndarray, start: int, tells: np.ndarray | None = None):
        self.steps, self.start, self.tells = steps, start, steps if tells is None else tells

    def run(self, codes: np.ndarray) -> bytes:
        states = np.arange(self.steps.shape[1])
        place, k, codes = states, 0, codes.tolist()
        while k < len(codes) and len(states) > 1:
            for c in codes[k : k + 16]:
                states = self.steps[c][states]
            states, met = np.unique(states, return_inverse=True)
            place, k = met[place], k + 16
        if k < len(codes):
            states = np.array([self._walk(int(states[0]), codes[k:])[0]])
        return states[place].astype("<i4").tobytes()

    def join(self, a: bytes, b: bytes) -> bytes:
        return np.frombuffer(b, dtype="<i4")[np.frombuffer(a, dtype="<i4")].tobytes()

    def enter(self, state: bytes | None, transition: bytes) -> bytes:
        return int(np.frombuffer(transition, dtype="<i4")[self.number(state)]).to_bytes(4, "little")

    def walk(self, state: bytes | None, codes: np.ndarray) -> dict[str, np.ndarray]:
        return {"told": np.array(self._walk(self.number(state), codes.tolist())[1], dtype=np.int64)}

    def number(self, state: bytes | None) -> int:
        return self.start if state is None else int.from_bytes(state, "little")

    def _walk(self, state: int, codes: list[int]) -> tuple[int, list[int]]:
        steps, tells, told = self.steps.tolist(), self.tells.tolist(), []
        for c in codes:
            told.append(tells[c][state])
            state = steps[c][state]
        return state, told


def feedback_table(gain: float, loss: float, keep: float, step: float) -> Table:
    """Scores from -1 to 1 by thousandths; code 1 is a gain, code 0 a loss. A row gets the score after it."""
    after = lambda s, f: math.floor(max(-1.0, min(1.0, s * keep + f * step)) * 1000 + 0.5)
    steps = np.array([[after(k / 1000, f) + 1000 for k in range(-1000, 1001)] for f in (loss, gain)])
    return Table(steps, 1000)


def pairing_table(ahead: int) -> Table:
    """Failures (code 0) wait for ``ahead`` calls; a success (code 1) goes to the one that has waited longest.

    The state is which of the last calls are waiting. A row gets how many calls before it the failure
    lies that takes it, 0 if there is none. That is what failures in order get, each taking the first success that is left.
    """
    full = (1 << ahead) - 1
    waits = np.arange(full + 1)
    oldest = np.array([int(m).bit_length() for m in waits])
    taken = np.where(oldest > 0, waits & ~(1 << np.maximum(oldest - 1, 0)), 0)
    return Table(np.stack([(waits << 1 | 1) & full, taken << 1 & full]), 0, np.stack([np.zeros_like(waits), oldest]))


Piece = tuple[int, int, int, int]  # low, high, slope, offset: from low to high the result is slope * x + offset


class Bucket:
    """A token bucket over event times in microseconds: full at first, refilled by time, emptied by ``cost`` a row if that much is there.

    Levels are counted in microseconds of refill, so all figures are whole. A run makes of the level at its first row (refilled)
    a piecewise function: level plus an offset, or a constant once the bucket has run over.
    A row gets whether it is allowed, how many whole tokens are left, and if it isn't, how many microseconds later it would be.
    """

    outputs = "allowed boolean, remaining long, retry_after_us long"

    def __init__(self, capacity: int, cost: int):
        self.capacity, self.cost = capacity, cost

    def _then(self, pieces: list[Piece], wait: int, after: list[Piece]) -> list[Piece]:
        """Pieces of: the first function, ``wait`` of refill, the second function."""
        lows = [p[0] for p in after]
        at = lambda x: next(s * x + c for _, _, s, c in (after[bisect_right(lows, x) - 1],))
        out: list[Piece] = []
        for low, high, slope, offset in pieces:
            if not slope:
                out.append((low, high, 0, at(min(self.capacity, offset + wait))))
                continue
            shift = offset + wait
            top = min(high, self.capacity - shift)
            for a, b, s, c in after:
                x, y = max(low, a - shift), min(top, b - shift)
                if x <= y:
                    out.append((x, y, s, s * shift + c))
            if top < high:
                out.append((max(low, top + 1), high, 0, at(self.capacity)))
        merged = out[:1]
        for low, high, slope, offset in out[1:]:
            if merged[-1][2:] == (slope, offset):
                merged[-1] = (merged[-1][0], high, slope, offset)
            else:
                merged.append((low, high, slope, offset))
        return merged

    def _step(self) -> list[Piece]:
        return [(0, self.cost - 1, 1, 0), (self.cost, self.capacity, 1, -self.cost)]

    def run(self, times: np.ndarray) -> bytes:
        times, step = times.tolist(), self._step()
        pieces, k = step, 1
        while k < len(times) and (len(pieces) > 1 or pieces[0][2]):
            pieces = self._then(pieces, times[k] - times[k - 1], step)
            k += 1
        if k < len(times):  # one constant is left: a plain fold
            level = pieces[0][3]
            for before, now in zip(times[k - 1 :], times[k:], strict=False):
                level = self._taken(min(self.capacity, level + now - before))[0]
            pieces = [(0, self.capacity, 0, level)]
        return json.dumps([times[0], times[-1], pieces]).encode()

    def join(self, a: bytes, b: bytes) -> bytes:
        (first, last, before), (begin, end, after) = json.loads(a), json.loads(b)
        return json.dumps([first, end, self._then([tuple(p) for p in before], begin - last, [tuple(p) for p in after])]).encode()

    def enter(self, state: bytes | None, transition: bytes) -> bytes:
        first, last, pieces = json.loads(transition)
        level = self._refilled(state, first)
        _, _, slope, offset = pieces[bisect_right([p[0] for p in pieces], level) - 1]
        return json.dumps([slope * level + offset, last]).encode()

    def walk(self, state: bytes | None, times: np.ndarray) -> dict[str, np.ndarray]:
        level, last, out = self.capacity, None, []
        if state is not None:
            level, last = json.loads(state)
        for now in times.tolist():
            level, ok = self._taken(level if last is None else min(self.capacity, level + now - last))
            out.append((ok, level // self.cost if ok else 0, 0 if ok else self.cost - level))
            last = now
        allowed, remaining, retry = np.array(out, dtype=np.int64).reshape(-1, 3).T
        return {"allowed": allowed.astype(bool), "remaining": remaining, "retry_after_us": retry}

    def _refilled(self, state: bytes | None, now: int) -> int:
        if state is None:
            return self.capacity
        level, last = json.loads(state)
        return min(self.capacity, level + now - last)

    def _taken(self, level: int) -> tuple[int, bool]:
        return (level - self.cost, True) if level >= self.cost else (level, False)
