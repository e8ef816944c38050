"""One row of each keyed fold, for :func:`chronopanel.streaming.stateful.ordered_fold`; the batch folds give the same rows.

A step takes the state (None for a new key) and a row as tuples in the order of their schemas and returns both anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from chronopanel.operators import folds as fo

CHANGE_STATE = "probability double, mean double"


def change(scale: float) -> Callable:
    """(time, id, value) -> (id, probability): the change detector."""
    def step(state, row):
        p, mean = state or (0.0, 0.0)
        surprise = min(1.0, max(0.0, (mean - row[2]) / scale))
        p = fo.HAZARD + (1 - fo.HAZARD) * (fo.DECAY * p + (1 - fo.DECAY) * surprise)
        return (p, fo.DECAY * mean + (1 - fo.DECAY) * row[2]), (row[1], p)
    return step


ACTIVITY_STATE = "hits long, seen long, at long"


def activity(state, row):
    """(time, id, eligible, traded) -> (id, a, b, streak, p_zero)."""
    hits, seen, at = state or (0, 0, 0)
    seen += bool(row[2])
    if row[2] and row[3]:
        hits, at = hits + 1, seen
    a, b, streak = 1.0 + hits, 1.0 + seen, seen - at
    return (hits, seen, at), (row[1], a, b, streak, (b / (b + streak)) ** a)


ALPHA_STATE = "discounted double, n long, probability double, mean double"


def forgetful(scale: float, discount: float = 0.97) -> Callable:
    """(time, id, value) -> (id, discounted, n, uncertainty): the discounted mean whose memory shortens after a change."""
    detect = change(scale)

    def step(state, row):
        held, n, *seen = state or (0.0, 0, None, None)
        memory = discount * (max(fo.LEAST_MEMORY, 1 - seen[0]) if n else 1.0)
        (p, mean), _ = detect(tuple(seen) if n else None, row)
        held = held * memory + row[2] * (1 - memory)
        return (held, n + 1, p, mean), (row[1], held, n + 1, 1 / math.sqrt(n + 1))
    return step


LIFE_STATE = "state string, sessions long"


def lifecycle(margin: float = 0.0) -> Callable:
    """(time, id, structural kill, statistical kill, candidate, bound) -> (id, state, sessions in it), by the declared table."""
    def step(state, row):
        before, sessions = state or ("SHADOW", -1)
        _, at, structural, statistical, candidate, bound = row
        kind = "strong" if candidate and bound is not None and bound > margin else "candidate" if candidate else "none"
        event = "structural" if structural else f"kill {kind}" if statistical else kind
        after = fo.LIFECYCLE.get((before, event), before)
        sessions = sessions + 1 if after == before or state is None else 0
        return (after, sessions), (at, after, sessions)
    return step


HYSTERESIS_STATE = "incumbent string, challenger string, confirmations long, evidence long, fingerprint long"


def hysteresis(confirmations: int = 2, least_folds: int = 0) -> Callable:
    """(time, id, evidence, fingerprint, winner, scores, folds) -> (id, incumbent before, after, challenger, confirmations, reason).

    Fails where the batch fold fails: dates that go back, changed evidence of one date, a winner or incumbent without a
    score or with too few folds. ``folds`` may be None without ``least_folds``.
    """
    def require(scores, folds, who, missing, short):
        if who not in scores or scores[who] is None:
            raise ValueError(missing)
        if least_folds and ((folds or {}).get(who) or 0) < least_folds:
            raise ValueError(short)

    def step(state, row):
        _, at, evidence, fingerprint, winner, scores, folds = row
        require(scores, folds, winner, fo.WINNER_MISSING, fo.WINNER_SHORT)
        if state is None:
            return (winner, None, 0, evidence, fingerprint), (at, None, winner, None, 0, fo.INITIAL)
        inc, waiting, streak, last, known = state
        if evidence < last:
            raise ValueError(fo.BACKWARDS)
        require(scores, folds, inc, fo.INCUMBENT_MISSING, fo.INCUMBENT_SHORT)
        if evidence == last or fingerprint == known:
            if fingerprint != known:
                raise ValueError(fo.CHANGED)
            return state, (at, inc, inc, waiting, streak, fo.DUPLICATE if evidence == last else fo.NOTHING_NEW)
        again = streak + 1 if waiting == winner else 1
        if winner == inc:
            return (inc, None, 0, evidence, fingerprint), (at, inc, inc, None, 0, fo.RECONFIRMED)
        if not scores[winner] > scores[inc]:
            return (inc, None, 0, evidence, fingerprint), (at, inc, inc, winner, 0, fo.NO_IMPROVEMENT)
        if again >= confirmations:
            return (winner, None, 0, evidence, fingerprint), (at, inc, winner, winner, again, fo.SWITCHED)
        return (inc, winner, again, evidence, fingerprint), (at, inc, inc, winner, again, fo.PENDING)
    return step
