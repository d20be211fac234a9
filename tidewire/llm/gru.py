"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, many documents side by side.

The next token's class is drawn from the state; a word of a head class is drawn within it from the state too. Documents lie
in lanes, one after the other; a state starts at zero with each document and is carried from window to window to its end.
"""

from __future__ import annotations

import heapq

import numpy as np

F4 = np.float32


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and place of each document's first token: longest first, to the lane with least; lanes from long to short."""
    lane, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    heap = [(0, k) for k in range(most)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        lane[d], at[d] = k, load
        heapq.heapreplace(heap, (load + int(sizes[d]), k))
    load = np.zeros(most, np.int64)
    for n, k in heap:
        load[k] = n
    rank = np.empty(most, np.int64)
    rank[np.argsort(-load, kind="stable")] = np.arange(most)
    return rank[lane], at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in the place of x: the sigmoid of -x."""
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _softmax(x: np.ndarray, most: float, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each column's target, and the gradient of their loss in the place of x, if it is wanted. Logits are within `most`: where that can't
    overflow, no column needs its own maximum; what training might push beyond is cut."""
    at = np.arange(x.shape[1])
    if most > 80:
        np.clip(x, -80, 80, out=x)
    picked = x[target, at]
    e = np.exp(x, out=x)
    total = np.ones(len(e), F4) @ e
    if learn:
        e /= total
        e[target, at] -= 1
    return picked - np.log(total), e


class Gru:
    """inputs: kinds of token that are read, and one for a document's start; class_of: each head word's class; n_classes: all classes, head first."""

    def __init__(self, inputs: int, class_of: np.ndarray, class_bias: np.ndarray, word_bias: np.ndarray, hidden: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.hidden, self.class_of = hidden, class_of
        self.words = [np.flatnonzero(class_of == c) for c in range(int(class_of.max()) + 1 if len(class_of) else 0)]
        self.within = np.zeros(len(class_of), np.int64)
        # Words by class and place; a shorter class ends in places without a word.
        self.places = np.zeros((len(self.words), max(map(len, self.words), default=0)), np.int64)
        self.real = np.zeros(self.places.shape, bool)
        for c, w in enumerate(self.words):
            self.within[w] = np.arange(len(w))
            self.places[c, : len(w)], self.real[c, : len(w)] = w, True
        self.p = {
            "x": (rng.standard_normal((inputs + 1, 3 * hidden)) * 0.3).astype(F4),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F4),
            "c": np.zeros((hidden, len(class_bias)), F4), "cb": class_bias.astype(F4),
            "w": np.zeros((len(class_of), hidden), F4), "wb": word_bias.astype(F4),
        }
        ends = np.cumsum([0, *(v.size for v in self.p.values())]).tolist()
        self.cuts = [(k, a, z, v.shape) for (k, v), a, z in zip(self.p.items(), ends, ends[1:])]
        self.m, self.v = np.zeros(ends[-1], F4), np.zeros(ends[-1], F4)
        self.updates = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a flat array, as the parameters lie in it."""
        return {k: flat[a:z].reshape(shape) for k, a, z, shape in self.cuts}

    def load(self, flat: np.ndarray) -> None:
        self.p = {k: v.astype(F4) for k, v in self.views(flat).items()}

    def forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, saved: list | None = None) -> np.ndarray:
        """States after reading x[t] for each t; h is that before. keep is 0 where a document starts. A state's numbers lie apart, those of all lanes side by side."""
        p, n = self.p, self.hidden
        # Gates by exp(-g), and the new state by exp(-2 g), so signs and the factor go to the weights.
        by = np.repeat(np.array([-1, -2], F4), [2 * n, n])[:, None]
        inputs, u = (np.multiply(p[k].T, by, order="C") for k in ("x", "u"))
        out, hs, un, new = (np.empty((len(x), n, x.shape[1]), F4) for _ in range(4))
        zr = np.empty((len(x), 2 * n, x.shape[1]), F4)
        g, a, d = np.empty((3 * n, x.shape[1]), F4), np.empty((3 * n, x.shape[1]), F4), np.empty((n, x.shape[1]), F4)
        h = h.T
        with np.errstate(over="ignore"):  # 1 / inf is the limit
            for t in range(len(x)):
                h = np.multiply(h, keep[t], out=hs[t])
                inputs.take(x[t], axis=1, out=g, mode="clip")
                np.matmul(u, h, out=a)
                gate, fresh = zr[t], new[t]
                _sigmoid(np.add(g[: 2 * n], a[: 2 * n], out=gate))
                un[t] = a[2 * n :]
                np.multiply(gate[n:], a[2 * n :], out=fresh)
                fresh += g[2 * n :]
                _sigmoid(fresh)
                fresh *= 2
                fresh -= 1
                np.subtract(h, fresh, out=d)
                d *= gate[:n]
                h = np.add(d, fresh, out=out[t])
        if saved is not None:
            un *= -0.5
            saved.append((hs, zr[:, :n], zr[:, n:], un, new))
        return out.transpose(0, 2, 1)

    def score(self, s: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each (class, head word or -1) from states s; with grads, adds to them, and returns the states' gradient of the loss too."""
        p, n, learn = self.p, self.hidden, grads is not None
        s1 = np.ones((n + 1, len(s)), F4)  # the last row is for the bias
        s1[:n] = s.T
        c1 = np.vstack([p["c"], p["cb"] - p["cb"].max()])
        out, e = _softmax(c1.T @ s1, np.abs(c1).sum(axis=0).max(), cls, learn)
        ds = None
        if learn:
            ds = p["c"] @ e
            c1 = e @ s1.T
            grads["c"] += c1[:, :n].T
            grads["cb"] += c1[:, n]
        head = np.flatnonzero(cls < len(self.words))
        if len(head):
            own = head[np.argsort(cls[head].astype(np.uint16), kind="stable")]
            ends = np.searchsorted(cls[own], np.arange(len(self.words) + 1)).tolist()
            s1 = s1[:, own]
            bias = np.where(self.real, p["wb"][self.places], -np.inf)
            w1 = np.concatenate([p["w"][self.places], np.where(self.real, bias - bias.max(axis=1, keepdims=True), 0)[:, :, None]], axis=2).astype(F4, copy=False)
            x = np.empty((w1.shape[1], len(own)), F4)
            parts = [(c, slice(a, z)) for c, (a, z) in enumerate(zip(ends, ends[1:])) if a < z]
            for c, k in parts:
                np.matmul(w1[c], s1[:, k], out=x[:, k])
                x[len(self.words[c]) :, k] = -np.inf
            more, e = _softmax(x, np.abs(w1).sum(axis=2).max(), self.within[word[own]], learn)
            out[own] += more
            if learn:
                d, g = np.empty((n, len(own)), F4), np.zeros_like(w1)
                for c, k in parts:
                    np.matmul(e[:, k], s1[:, k].T, out=g[c])
                    np.matmul(w1[c, :, :n].T, e[:, k], out=d[:, k])
                grads["w"][self.places[self.real]] += g[self.real][:, :n]
                grads["wb"][self.places[self.real]] += g[self.real][:, n]
                ds[:, own] += d
        return out, None if ds is None else ds.T

    def backward(self, x, keep, saved, ds, grads) -> None:
        """Adds to grads what ds, the states' gradient, gives."""
        n, u = self.hidden, self.p["u"]
        h, z, r, un, new = saved[0]
        ds = ds.transpose(0, 2, 1)
        # What a state's gradient gives of its gates before the matrix, and of its new part.
        by = np.empty((len(x), 3, n, x.shape[1]), F4)
        np.multiply(z, 1 - z, out=by[:, 0])
        by[:, 0] *= h - new
        fresh = (1 - z) * (1 - new * new)
        np.multiply(fresh, r, out=by[:, 2])
        np.multiply(by[:, 2], 1 - r, out=by[:, 1])
        by[:, 1] *= un
        du, all_dh = np.empty_like(by), np.empty(h.shape, F4)
        gates = du.reshape(len(x), 3 * n, -1)
        dh, back = np.zeros(h.shape[1:], F4), np.empty(h.shape[1:], F4)
        for t in range(len(x) - 1, -1, -1):
            now = np.add(dh, ds[t], out=all_dh[t])
            np.multiply(by[t], now, out=du[t])
            np.matmul(u, gates[t], out=back)
            np.multiply(now, z[t], out=dh)
            dh += back
            dh *= keep[t]
        grads["u"] += np.matmul(h, gates.transpose(0, 2, 1)).sum(axis=0)
        np.multiply(all_dh, fresh, out=du[:, 2])
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["x"][ids[first]] += np.add.reduceat(gates.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first, axis=0)

    def update(self, g: np.ndarray, tokens: int, rate: float) -> None:
        self.updates += 1
        fix = np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        g /= tokens
        np.clip(g, -0.1, 0.1, out=g)
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        step = float(rate * fix) * self.m / (np.sqrt(self.v) + 1e-6)
        for k, x in self.views(step).items():
            self.p[k] -= x

    def run(self, size: np.ndarray, read: np.ndarray, cls: np.ndarray, word: np.ndarray, wide: int, window: int, rate: float = 0.0) -> np.ndarray:
        """Log probability of each token of documents of these sizes; with a rate, learns from each window after scoring it."""
        size = np.asarray(size, np.int64)
        wide = max(1, min(wide, len(size)))
        lane, at = lanes(size, wide)
        first = np.cumsum(size) - size
        step = np.arange(len(cls)) + np.repeat(at - first, size)
        of = np.repeat(lane, size)
        length = np.zeros(wide, np.int64)
        np.maximum.at(length, lane, at + size)
        out = np.empty(len(cls))
        starts = np.zeros(len(cls), bool)
        starts[first[size > 0]] = True
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        edges = np.searchsorted(step[order], np.arange(0, int(length.max(initial=0)) + window, window))
        h = np.zeros((wide, self.hidden), F4)
        for k in range(len(edges) - 1):
            own = order[edges[k] : edges[k + 1]]
            t, b = step[own] - k * window, of[own]
            a = int(b.max()) + 1
            shape = (int(t.max()) + 1, a)
            x, keep, at = np.zeros(shape, np.int64), np.ones(shape, F4), t * a + b
            x.ravel()[at], keep.ravel()[at] = read[own], ~starts[own]
            saved = [] if rate else None
            s = self.forward(x, keep, h[:a], saved)
            h = s[-1]
            told = np.take(s.transpose(2, 0, 1).reshape(self.hidden, -1), at, axis=1, mode="clip").T
            if rate:
                sums = np.zeros(len(self.m), F4)
                grads = self.views(sums)
                out[own], d = self.score(told, cls[own], word[own], grads)
                ds = np.zeros((self.hidden, *shape), F4)
                ds.reshape(self.hidden, -1)[:, at] = d.T
                self.backward(x, keep, saved, ds.transpose(1, 2, 0), grads)
                # Windows with few lanes left, of the longest documents, weigh by their tokens.
                self.update(sums, len(own), rate * len(own) / (wide * window) / (1 + self.updates / 500))
            else:
                out[own], _ = self.score(told, cls[own], word[own])
        return out
