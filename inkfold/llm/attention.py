"""A small causal self-attention model over token ids, in numpy: training by Adagrad, and scoring by overlapping windows.

A position's vector is that of its id plus one of the id before it. One layer of masked attention with learned distances and one of rectified
units add to it. The next id is told in two steps, as a class and a place in the class (``Codes``), both by softmax over that vector;
rare ids share the last class, where their places follow their corpus counts. So every id has a probability, and they sum to one.

A text is a line of ids between two ends. A window is ``WIDTH`` positions; each following window begins ``STEP`` further and scores
only what the ones before have not, so each id is scored once, by at least ``WIDTH - STEP`` positions of context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, STEP = 24, 20
DIM, HIDDEN = 16, 32
#: Classes of ``PLACES`` ids each, the last of them the rare ids; rows of the input tables, the last ``SHARED`` for rare ids.
CLASSES, PLACES, ROWS, SHARED = 32, 32, 4096, 64
#: Windows in one call.
TOGETHER = 256
#: Part of the rate for the tables that every position uses.
SLOW = np.float32(0.2)
f4 = np.float32
#: More bytes than any array of a step.
LARGE = 8 << 20


@dataclass
class Codes:
    """What ids stand for: ``row`` of the input tables, ``kind`` (class) and ``place``, and ``rare``: log share inside the last class."""

    row: np.ndarray
    kind: np.ndarray
    place: np.ndarray
    rare: np.ndarray
    share: np.ndarray  # of classes, then of places in them: the start of the biases


def codes(counts: np.ndarray) -> Codes:
    """From the count of each id in the training texts; the most frequent come first, ties by id."""
    n, frequent = len(counts), (CLASSES - 1) * PLACES
    order = np.lexsort((np.arange(n), -counts))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    row = np.where(rank < ROWS - SHARED, rank, ROWS - SHARED + np.arange(n) % SHARED)
    kind = np.minimum(rank // PLACES, CLASSES - 1)
    place = np.where(kind < CLASSES - 1, rank % PLACES, 0)
    smooth = counts + 0.5
    tail = rank >= frequent
    rare = np.where(tail, np.log(smooth / max(smooth[tail].sum(), 0.5)), 0)
    share = np.zeros((CLASSES, 1 + PLACES))
    share[:, 0] = np.log(np.bincount(kind, smooth, CLASSES) / smooth.sum() + 1e-12)
    inner = np.full((CLASSES, PLACES), -30.0)
    inner[kind[~tail], place[~tail]] = np.log(smooth[~tail])
    share[:, 1:] = inner - np.log(np.exp(inner).sum(axis=1, keepdims=True))
    return Codes(row.astype(np.int32), kind.astype(np.int32), place.astype(np.int32), rare, share)


def start(code: Codes, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(f4)
    model = {"now": small(ROWS, DIM), "last": small(ROWS, DIM)}
    model |= {k: (rng.normal(size=(DIM, DIM)) * DIM**-0.5).astype(f4) for k in ("q", "k", "v", "o")}
    model |= {"far": np.zeros(WIDTH, f4), "in": (rng.normal(size=(DIM, HIDDEN)) * DIM**-0.5).astype(f4), "shift": np.zeros(HIDDEN, f4), "out": small(HIDDEN, DIM)}
    model |= {"class": small(DIM, CLASSES), "class0": code.share[:, 0].astype(f4), "place": small(CLASSES, DIM, PLACES), "place0": code.share[:, 1:].astype(f4)}
    return model


_DISTANCE = np.maximum(np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :], 0)
_SEEN = (np.arange(WIDTH)[:, None] >= np.arange(WIDTH)[None, :]).astype(f4)


_ONES = np.ones((WIDTH, 1), f4)


def _bound(x: np.ndarray, high: float, low: float | None = None) -> np.ndarray:
    """``np.clip`` in place; looking first is many times as fast as clipping, and hardly ever is there anything to clip."""
    if x.size and (x.max() > high or (low is not None and x.min() < low)):
        np.clip(x, low, high, out=x)
    return x


def joined(model) -> tuple[np.ndarray, np.ndarray]:
    """What "q" and "k", and "v" and "o", amount to as one product each: keys and values are then the vectors themselves."""
    return model["q"] @ model["k"].T * f4(DIM**-0.5), model["v"] @ model["o"]


def hidden(model, now: np.ndarray, last: np.ndarray, at: np.ndarray, keep: dict) -> np.ndarray:
    """Vectors at the places ``at`` of rows of ids and of the ids before them, a one at the end of each; ``keep`` gets what the gradients need."""
    qk, vo = joined(model)
    h = np.take(model["now"], now.ravel(), axis=0)
    h += np.take(model["last"], last.ravel(), axis=0)
    line, asked = h.reshape(*now.shape, DIM), (h @ qk).reshape(*now.shape, DIM)
    a = np.matmul(asked, line.transpose(0, 2, 1))
    a += model["far"][_DISTANCE]
    np.exp(_bound(a, 40, -40), out=a)
    a *= _SEEN
    a /= (a.reshape(-1, WIDTH) @ _ONES).reshape(*now.shape, 1)
    met = np.matmul(a, line).reshape(-1, DIM)
    # what follows is done for each position by itself
    own = np.take(met, at, axis=0)
    h1 = np.take(h, at, axis=0)
    h1 += own @ vo
    z = h1 @ model["in"]
    z += model["shift"]
    np.maximum(z, 0, out=z)
    out = np.ones((len(at), DIM + 1), h.dtype)
    np.add(h1, z @ model["out"], out=out[:, :DIM])
    keep.update(h=h, qk=qk, vo=vo, asked=asked, a=a, met=met, own=own, h1=h1, z=z)
    return out


def _told(x: np.ndarray, own: np.ndarray, n: int) -> float:
    """The sum of -log softmax of each row of ``x`` at ``own``; ``x`` becomes its gradient, divided by ``n``."""
    np.exp(_bound(x, 80), out=x)
    flat, place = x.ravel(), np.arange(len(x)) * x.shape[1] + own
    total = x @ np.ones((x.shape[1], 1), x.dtype) + f4(1e-37)
    loss = -np.log(flat.take(place) / total[:, 0] + 1e-30).sum()
    x *= 1 / (total * x.dtype.type(n))
    flat[place] -= x.dtype.type(1 / n)
    return loss


class Scorer:
    """A trained model laid out for scoring: the projections of the input tables and the biases are part of the tables."""

    def __init__(self, model: dict[str, np.ndarray], code: Codes):
        self.code, self.model = code, model
        qk, self.vo = joined(model)
        wide = np.concatenate([np.eye(DIM, dtype=f4), qk], axis=1)
        self.now, self.last = model["now"] @ wide, model["last"] @ wide
        self.far = model["far"][_DISTANCE]
        self.classes = np.concatenate([model["class"], model["class0"][None]])
        self.places = np.concatenate([model["place"], model["place0"][:, None, :]], axis=1)
        self.one, self.each = np.ones((WIDTH, 1), f4), np.ones(PLACES, f4)

    def hidden(self, now: np.ndarray, last: np.ndarray, at: np.ndarray | None = None, lead: int = 0) -> np.ndarray:
        """As :func:`hidden`; all places without ``at``. No window has a place before its position ``lead``, so nothing is asked from there."""
        m = self.model
        at = np.arange(now.size) if at is None else at
        x = np.take(self.now, now, axis=0)
        x += np.take(self.last, last, axis=0)
        h, asked = x[..., :DIM], x[:, lead:, DIM:]
        a = np.matmul(asked, h.transpose(0, 2, 1))
        a += self.far[lead:]
        np.exp(_bound(a, 40), out=a)
        a *= _SEEN[lead:]
        met = np.matmul(a, h).reshape(-1, DIM)
        met /= a.reshape(-1, WIDTH) @ self.one + f4(1e-30)
        h, met = np.take(x.reshape(-1, 2 * DIM), at, axis=0)[:, :DIM], np.take(met, at - (at // WIDTH + 1) * lead, axis=0)
        h1 = met @ self.vo
        h1 += h
        z = h1 @ m["in"]
        z += m["shift"]
        np.maximum(z, 0, out=z)
        out = np.ones((len(h1), DIM + 1), f4)
        np.add(h1, z @ m["out"], out=out[:, :DIM])
        return out

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each id, given the vector before it."""
        code, n = self.code, len(ids)
        kind = code.kind[ids]
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edge = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        h, ids, kind = np.take(h, order, axis=0), ids[order], kind[order]
        x = h @ self.classes
        y = np.empty((edge[-2], PLACES), f4)
        for c, (a, b) in enumerate(zip(edge[:-2].tolist(), edge[1:-1].tolist(), strict=True)):
            if a < b:
                np.matmul(h[a:b], self.places[c], out=y[a:b])
        got = np.empty(n)
        got[order] = self._softmax(x, kind) + np.concatenate([self._softmax(y, code.place[ids[: len(y)]]), code.rare[ids[len(y) :]]])
        return got

    def _softmax(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        _bound(x, 80)
        out = x.ravel().take(np.arange(len(x)) * x.shape[1] + own).astype(np.float64)
        np.exp(x, out=x)
        return out - np.log(x @ self.each + f4(1e-37))

    def score(self, ids: np.ndarray, offs: np.ndarray, end: int) -> np.ndarray:
        """log10 of the probability of each text, its end included."""
        out = np.zeros(len(offs) - 1)
        for text, now, last, then, on in batches(ids, offs, end):
            at = np.flatnonzero(on)
            got = self.log_probabilities(self.hidden(self.code.row[now], self.code.row[last], at, int(on.any(axis=0).argmax())), then.ravel()[at])
            out += np.bincount(text[at // WIDTH], got, len(out))
        return out / np.log(10)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many positions each: text, first position, first scored position, end, of all windows."""
    more = np.maximum(-(-(lengths - WIDTH) // STEP), 0)
    text = np.repeat(np.arange(len(lengths)), more + 1)
    k = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    first = k * STEP
    return text, first, np.where(k > 0, first + WIDTH - STEP, 0), np.minimum(first + WIDTH, lengths[text])


def line(ids: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, an end before and after each, and where each text's first end stands."""
    n = np.diff(offs)
    at = offs[:-1] + 2 * np.arange(len(n))
    out = np.full(len(ids) + 2 * len(n), end, np.int64)
    out[np.arange(len(ids)) + np.repeat(at - offs[:-1] + 1, n)] = ids
    return out, at


def _cut(whole: np.ndarray, at: np.ndarray, text: np.ndarray, first: np.ndarray, scored: np.ndarray, stop: np.ndarray) -> tuple:
    """(inputs, ids before them, targets, mask of scored positions) of these windows."""
    place = first[:, None] + np.arange(WIDTH)
    on = (place >= scored[:, None]) & (place < stop[:, None])
    # before a text's first end stands the last end of another text
    seen = whole[np.minimum((at[text] + first)[:, None] + np.arange(-1, WIDTH + 1), len(whole) - 1)]
    return seen[:, 1:-1], seen[:, :-2], seen[:, 2:], on


def batches(ids: np.ndarray, offs: np.ndarray, end: int, together: int = TOGETHER):
    """(text, inputs, ids before them, targets, mask of scored positions) of the windows of these texts."""
    whole, at = line(ids, offs, end)
    found = windows(np.diff(offs) + 1)
    order = np.argsort(found[2] > 0, kind="stable")  # windows that begin a text are scored from their first position on, others later
    for a in range(0, len(order), together):
        some = [x[order[a : a + together]] for x in found]
        yield some[0], *_cut(whole, at, *some)


def gradients(model, code: Codes, now: np.ndarray, last: np.ndarray, then: np.ndarray, on: np.ndarray) -> tuple[float, dict, dict]:
    """Mean loss of the masked positions, gradients of the small tables, and (rows, gradients) of the input tables."""
    kept: dict = {}
    n1 = code.row[now]
    at = np.flatnonzero(on)
    ids = then.ravel()[at]
    n = max(1, len(ids))
    # positions in the order of their classes, so that all places are one array
    order = np.argsort(code.kind[ids].astype(np.uint8), kind="stable")
    at, ids = at[order], ids[order]
    kind = code.kind[ids]
    h2 = hidden(model, n1, code.row[last], at, kept)
    edge = np.searchsorted(kind, np.arange(CLASSES)).tolist()
    g: dict = {}
    x = h2 @ np.concatenate([model["class"], model["class0"][None]])
    loss = _told(x, kind, n) - code.rare[ids[edge[-1] :]].sum()
    both = x.T @ h2
    g["class"], g["class0"] = both[:, :DIM].T, both[:, DIM]
    back = x @ model["class"].T
    places = np.concatenate([model["place"], model["place0"][:, None, :]], axis=1)
    both, y = np.zeros_like(places), np.empty((edge[-1], PLACES), h2.dtype)
    parts = [(c, a, b) for c, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
    for c, a, b in parts:
        np.matmul(h2[a:b], places[c], out=y[a:b])
    loss += _told(y, code.place[ids[: edge[-1]]], n)
    for c, a, b in parts:
        np.matmul(h2[a:b].T, y[a:b], out=both[c])
        back[a:b] += y[a:b] @ model["place"][c].T
    g["place"], g["place0"] = both[:, :DIM], both[:, DIM]
    qk, vo, asked, a, met, own, h1, z, h0 = (kept[i] for i in ("qk", "vo", "asked", "a", "met", "own", "h1", "z", "h"))
    dz = back @ model["out"].T
    dz *= z > 0
    g["out"], g["in"], g["shift"] = z.T @ back, (dz.T @ h1).T, np.ones(len(dz), dz.dtype) @ dz
    d1 = dz @ model["in"].T
    d1 += back
    both = own.T @ d1
    g["v"], g["o"] = both @ model["o"].T, model["v"].T @ both
    # back to all positions of the windows
    line, dmet = h0.reshape(*now.shape, DIM), np.zeros_like(met)
    dmet[at] = d1 @ vo.T
    ds = np.matmul(dmet.reshape(asked.shape), line.transpose(0, 2, 1))
    ds -= np.einsum("ij,ij->i", dmet, met).reshape(len(now), -1, 1)
    ds *= a
    g["far"] = np.bincount(_DISTANCE.ravel(), (ds.sum(axis=0) * _SEEN).ravel(), WIDTH).astype(f4)
    dq = np.matmul(ds, line).reshape(-1, DIM)
    d0 = np.matmul(ds.transpose(0, 2, 1), asked)
    d0 += np.matmul(a.transpose(0, 2, 1), dmet.reshape(asked.shape))
    d0 += (dq @ qk.T).reshape(asked.shape)
    d0 = d0.reshape(-1, DIM)
    d0[at] += d1
    both = h0.T @ dq * f4(DIM**-0.5)
    g["q"], g["k"] = both @ model["k"], both.T @ model["q"]
    # an id is met as the one at a position and as the one before the next: sorted once for both tables
    rows = np.concatenate([code.row[last[:, :1]], n1], axis=1).ravel()
    d = np.zeros((len(now), WIDTH + 1, 2 * DIM), h0.dtype)
    d[:, 1:, :DIM] = d[:, :-1, DIM:] = d0.reshape(line.shape)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    # as complex numbers, two sums at once
    d = np.take(d.reshape(-1, 2 * DIM), order, axis=0).view(np.result_type(d, np.complex64))
    d = np.add.reduceat(d, first, axis=0).view(h0.dtype)
    return float(loss) / n, g, {"now": (rows[first], d[:, :DIM]), "last": (rows[first], d[:, DIM:])}


def train(model, code: Codes, ids: np.ndarray, offs: np.ndarray, end: int, tokens: int, rate: float, seed: int = 0, together: int = 48) -> float:
    """Adagrad over the windows of these texts in random order, until ``tokens`` positions were met; the rate falls to a fifth. The last mean loss."""
    if len(offs) < 2:
        return 0.0
    own, held = model, {k: np.full_like(model[k], 1e-4) for k in ("now", "last")}
    # the tables that every position uses lie in one array
    small = [k for k in model if k not in held]
    edge = np.cumsum([0, *(model[k].size for k in small)])
    flat = np.concatenate([model[k].ravel() for k in small])
    model = {k: model[k] for k in held} | {k: flat[a:b].reshape(model[k].shape) for k, a, b in zip(small, edge[:-1], edge[1:], strict=True)}
    part = np.concatenate([np.full(model[k].size, 1 if k in ("place", "place0") else SLOW, f4) for k in small])
    size = np.full_like(flat, 1e-4)
    np.empty(LARGE, np.uint8)  # once so much was freed, malloc keeps what a step frees for the next one
    whole, start = line(ids, offs, end)
    found = windows(np.diff(offs) + 1)
    rng, met, mean = np.random.default_rng(seed), 0, 0.0
    while met < tokens:
        order = rng.permutation(len(found[0]))
        for a in range(0, len(order), together):
            at = order[a : a + together]
            now, last, then, on = _cut(whole, start, *(x[at] for x in found))
            loss, g, sparse = gradients(model, code, now, last, then, on)
            mean += (loss - mean) * 0.02 if mean else loss
            step = f4(rate * (1 - 0.8 * min(1.0, met / tokens)))
            d = np.concatenate([g[k].ravel() for k in small])
            size += d * d
            d /= np.sqrt(size)
            d *= part
            d *= step
            flat -= d
            for k, (rows, d) in sparse.items():
                sums = np.take(held[k], rows, axis=0)
                sums += d * d
                held[k][rows] = sums
                model[k][rows] -= step * d / np.sqrt(sums)
            met += int(on.sum())
            if met >= tokens:
                break
    for k in small:
        own[k][...] = model[k]
    return mean
