"""The registration state of a term as composable functions of its events.

A run of events, in (ts, seq) order, changes any state before it in a way that a few values tell (``Change``), and the
changes of two runs that follow one another compose to one change. So a term's events are kept by buckets of time: a late event
is sorted into its bucket, only that bucket's change is made anew, and the state is the composition of the buckets' changes in order.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import NamedTuple

#: Microseconds of a bucket.
BUCKET = 3_600_000_000


class State(NamedTuple):
    enabled: bool
    normalized: str
    approval_count: int
    registered_at: int
    last_seen_at: int


class Event(NamedTuple):
    ts: int
    seq: int
    op: str
    normalized: str | None
    enabled: bool | None


@dataclass
class Change:
    """What a run of events does.

    To a term that exists: ``enabled`` and ``seen`` as last set; ``before`` registrations, then an update to ``first`` (if any), which resets the count where
    the form was another one, and ``after`` registrations since the last reset behind it, the form then being ``last``; ``again`` tells that a later update
    changed the form once more, so that nothing before it counts. To a term that doesn't: ``born``, the state it then has, if any.
    """

    enabled: bool | None = None
    seen: int | None = None
    before: int = 0
    first: str | None = None
    again: bool = False
    after: int = 0
    last: str | None = None
    born: State | None = None

    def applied(self, state: State | None) -> State | None:
        if state is None:
            return self.born
        count, form = state.approval_count + self.before, state.normalized
        if self.first is not None:
            kept = 0 if self.again or form != self.first else count
            count, form = kept + self.after, self.last
        return State(
            state.enabled if self.enabled is None else self.enabled, form, count, state.registered_at,
            state.last_seen_at if self.seen is None else self.seen,
        )

    def then(self, other: Change) -> Change:
        """This run followed by another."""
        out = Change(
            self.enabled if other.enabled is None else other.enabled, self.seen if other.seen is None else other.seen,
            self.before, self.first, self.again, self.after, self.last, other.applied(self.born),
        )
        if self.first is None:
            out.before, out.first, out.again, out.after, out.last = self.before + other.before, other.first, other.again, other.after, other.last
        elif other.first is None:
            out.after = self.after + other.before
        else:
            out.last = other.last
            if other.first != self.last:
                out.again, out.after = True, other.after
            elif other.again:
                out.again, out.after = True, other.after
            else:
                out.after = self.after + other.before + other.after
        return out


def change_of(e: Event) -> Change:
    """One event; a registration of a term that doesn't exist is its birth, which counts for nothing."""
    norm = None if e.normalized is None else e.normalized.strip()
    if e.op == "register":
        return Change(enabled=True, seen=e.ts, before=1, born=State(True, norm or "", 0, e.ts, e.ts))
    if e.op == "toggle":
        return Change(enabled=e.enabled)
    if e.op == "update":
        return Change(enabled=e.enabled, seen=e.ts, first=norm, last=norm)
    return Change()


def folded(changes) -> Change:
    out = Change()
    for c in changes:
        out = out.then(c)
    return out


def bucket_of(ts: int) -> int:
    return ts // BUCKET


def dump(x) -> str:
    return json.dumps(asdict(x) if isinstance(x, Change) else x)


def load_change(text: str) -> Change:
    d = json.loads(text)
    born = d.pop("born")
    return Change(**d, born=State(*born) if born else None)


def load_events(text: str) -> list[Event]:
    return [Event(*e) for e in json.loads(text)]
