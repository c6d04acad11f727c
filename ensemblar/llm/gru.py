"""A gated recurrent language model in numpy with a class-factored output softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent, which doesn't overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _softmax(x: np.ndarray, target: np.ndarray, all_of_it: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability of each column's target, and all probabilities in place of x (unnormalised without ``all_of_it``)."""
    x -= x.max(0)
    own = x[target, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(0)
    if all_of_it:
        x /= total
    return own - np.log(total), x


def classes(counts: np.ndarray, most: int) -> np.ndarray:
    """Starts of classes of neighbouring words, by equal shares of the roots of their (falling) counts; the number of words ends the list."""
    if not len(counts):
        return np.zeros(1, np.int64)
    share = np.cumsum(np.sqrt(counts))
    kind = np.minimum((share - np.sqrt(counts) / 2) / share[-1] * most, most - 1).astype(np.int64)
    return np.concatenate([np.flatnonzero(np.diff(kind, prepend=-1)), [len(counts)]])


@dataclass
class Gru:
    """Words 0..n_words are predicted one by one, all others as one last class.

    Inputs are the words, then ``n_extra`` marks for other words, then the
    mark of a text's start. ``starts`` gives the classes of words.
    """

    starts: np.ndarray
    n_extra: int = 64
    hidden: int = 24
    seed: int = 0
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.n_words, self.n_classes = int(self.starts[-1]), len(self.starts) - 1
        self.kind = np.repeat(np.arange(self.n_classes), np.diff(self.starts)).astype(np.int64)
        self.start_mark = self.n_words + self.n_extra
        if not self.params:
            h, rng = self.hidden, np.random.default_rng(self.seed)
            draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(h)).astype(np.float32)
            self.params = {
                "inputs": 0.3 * draw(self.start_mark + 1, 3 * h), "gates": draw(h, 2 * h), "state": draw(h, h),
                "kinds": 0.1 * draw(h, self.n_classes + 1), "kinds_bias": np.zeros(self.n_classes + 1, np.float32),
                "words": 0.1 * draw(self.n_words, h), "words_bias": np.zeros(self.n_words, np.float32),
            }

    def parts(self) -> tuple[np.ndarray, ...]:
        """Inputs of the update and reset gates and of the new state, and both gates, each a block of its own: what goes over a part then goes over whole blocks."""
        p, n = self.params, self.hidden
        return tuple(map(np.ascontiguousarray, (p["inputs"][:, :n], p["inputs"][:, n : 2 * n], p["inputs"][:, 2 * n :], p["gates"][:, :n], p["gates"][:, n:])))

    def step(self, ids: np.ndarray, h: np.ndarray, parts: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """The next state, and what going back needs; ``parts`` are those of the parameters as they are."""
        in_update, in_reset, in_new, update, reset = parts or self.parts()
        u = h @ update
        u += in_update.take(ids, 0)
        u = _sigmoid(u)
        r = h @ reset
        r += in_reset.take(ids, 0)
        r = _sigmoid(r)
        past = h @ self.params["state"]
        new = r * past
        new += in_new.take(ids, 0)
        np.tanh(new, out=new)
        out = new - h
        out *= u
        out += h
        return out, u, r, past, new

    def log_prob(self, h: np.ndarray, target: np.ndarray, slopes: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target (any number from n_words on: some other word) and, with ``slopes``, the slope by h."""
        p = self.params
        kind = np.append(self.kind, self.n_classes).take(np.minimum(target, self.n_words))
        # a column a token: what goes over a token's choices then goes over whole rows
        side = np.ascontiguousarray(h.T)
        logits = p["kinds"].T @ side
        logits += p["kinds_bias"][:, None]
        logs, d = _softmax(logits, kind, slopes is not None)
        out = logs.astype(np.float64)
        back = None
        if slopes is not None:
            d[kind, np.arange(len(target))] -= 1
            slopes["kinds"] += side @ d.T
            slopes["kinds_bias"] += d.sum(1)
            back = d.T @ p["kinds"].T
        # a class's tokens side by side
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.n_classes + 1))
        states, goals, more = h.take(order[: ends[-1]], 0), target.take(order[: ends[-1]]), np.zeros(ends[-1])
        returned = None if slopes is None else np.zeros_like(states)
        for k in np.flatnonzero(np.diff(ends)):
            low, high = self.starts[k], self.starts[k + 1]
            if high - low == 1:
                continue
            at = slice(ends[k], ends[k + 1])
            state, local = states[at], goals[at] - low
            logits = p["words"][low:high] @ state.T
            logits += p["words_bias"][low:high, None]
            more[at], d = _softmax(logits, local, slopes is not None)
            if slopes is not None:
                d[local, np.arange(len(local))] -= 1
                slopes["words"][low:high] += d @ state
                slopes["words_bias"][low:high] += d.sum(1)
                np.matmul(d.T, p["words"][low:high], out=returned[at])
        out[order[: ends[-1]]] += more
        if slopes is not None:
            back[order[: ends[-1]]] += returned
        return out, back

    def train(self, ids: np.ndarray, target: np.ndarray, first: np.ndarray, streams: int = 64, window: int = 16, rate: float = 0.1, passes: int = 1, seen: dict[str, np.ndarray] | None = None) -> float:
        """Truncated backpropagation through time over every token; returns the mean loss of the last tenth.

        ids: inputs; target: what follows; first: whether a text starts there, where
        the state is zero. The tokens are cut into ``streams`` that run side by side (the last ones end earlier); slopes
        go back over ``window`` steps, states go on to the next window. Steps are AdaGrad's, whose
        sums ``seen`` of former calls are taken and added to.
        """
        if len(ids) < streams:
            streams = 1
        n = -(-len(ids) // streams)
        side = lambda x, fill: np.concatenate([x, np.full(streams * n - len(x), fill, x.dtype)]).reshape(streams, n).T
        there = side(np.ones(len(ids), bool), False)
        ids, target, first = side(ids, 0), side(target, 0), side(first, False)
        begins = first.any(1).tolist()
        seen = self.no_slopes() if seen is None else seen
        p, m, losses = self.params, self.hidden, []
        for _ in range(passes):
            h = np.zeros((streams, m), np.float32)
            for at in range(0, n, window):
                steps = range(at, min(at + window, n))
                held, parts = [], self.parts()
                for t in steps:
                    before = h
                    if begins[t]:
                        before = h.copy()
                        before[first[t]] = 0
                    h, u, r, past, new = self.step(ids[t], before, parts)
                    held.append((before, u, r, past, new, h))
                slopes = {k: np.zeros_like(v) for k, v in p.items() if k != "inputs"}
                keep = np.flatnonzero(there[at : at + window])
                states = np.concatenate([x[5] for x in held])
                goals, full = target[at : at + window].reshape(-1), len(keep) == len(states)
                logs, got = self.log_prob(states if full else states[keep], goals if full else goals[keep], slopes)
                losses.append(-logs.mean())
                back = got
                if not full:
                    back = np.zeros_like(states)
                    back[keep] = got
                back, d_next = back.reshape(len(held), streams, m), np.zeros_like(h)
                d_u, d_r, d_new, d_past = (np.empty(back.shape, back.dtype) for _ in range(4))
                update, reset, state = parts[3].T, parts[4].T, p["state"].T
                for k in range(len(held) - 1, -1, -1):
                    before, u, r, past, new, _ = held[k]
                    d = back[k] + d_next
                    rest = 1 - u
                    slope = new * new
                    np.subtract(1, slope, out=slope)
                    slope *= u
                    np.multiply(d, slope, out=d_new[k])
                    np.subtract(new, before, out=slope)
                    slope *= u
                    d *= rest
                    np.multiply(d, slope, out=d_u[k])
                    np.multiply(d_new[k], r, out=d_past[k])
                    np.subtract(1, r, out=slope)
                    slope *= past
                    np.multiply(d_past[k], slope, out=d_r[k])
                    d += d_u[k] @ update
                    d += d_r[k] @ reset
                    d += d_past[k] @ state
                    if begins[at + k]:
                        d[first[at + k]] = 0
                    d_next = d
                rows = np.concatenate([d_u, d_r, d_new], 2).reshape(-1, 3 * m)
                befores = np.concatenate([x[0] for x in held])
                slopes["gates"] += befores.T @ rows[:, : 2 * m]
                slopes["state"] += befores.T @ d_past.reshape(-1, m)
                marks = ids[at : at + window].reshape(-1)
                # only the inputs that occur have slopes
                order = np.argsort(marks.astype(np.int16 if self.start_mark < 1 << 15 else np.int32), kind="stable")
                begin = np.flatnonzero(np.diff(marks[order], prepend=-1))
                used = marks[order[begin]]
                slopes["inputs"] = np.add.reduceat(rows.take(order, 0), begin)
                for k, d in slopes.items():
                    d /= streams
                    np.clip(d, -5, 5, out=d)
                    at_k = used if k == "inputs" else slice(None)
                    seen[k][at_k] += d * d
                    p[k][at_k] -= rate * d / np.sqrt(seen[k][at_k])
        return float(np.mean(losses[-max(1, len(losses) // 10) :])) if losses else 0.0

    def no_slopes(self) -> dict[str, np.ndarray]:
        """AdaGrad's sums before the first step."""
        return {k: np.full_like(v, 1e-6) for k, v in self.params.items()}

    def score(self, ids: np.ndarray, target: np.ndarray, lengths: np.ndarray, window: int = 1 << 14) -> np.ndarray:
        """The log-probability (natural) of each text; ids and target hold the texts one after another.

        Texts run side by side, longest first, so that those still going on stand in front. The state
        is carried from window to window, each of about ``window`` tokens, until a text ends.
        """
        order = np.argsort(-lengths, kind="stable")
        start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        h, total = np.zeros((len(order), self.hidden), np.float32), np.zeros(len(order))
        going = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        states, places, held, parts = [], [], 0, self.parts()
        for t, n in enumerate(going.tolist()):
            place = start[:n] + t
            h = self.step(ids[place], h[:n], parts)[0]
            states.append(h)
            places.append(place)
            held += n
            if held >= window or t + 1 == len(going):
                logs, _ = self.log_prob(np.concatenate(states), target[np.concatenate(places)])
                at = 0
                for x in places:
                    total[: len(x)] += logs[at : at + len(x)]
                    at += len(x)
                states, places, held = [], [], 0
        out = np.empty(len(order))
        out[order] = total
        return out
