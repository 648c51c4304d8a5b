"""A gated recurrent language model in numpy: many documents side by side, one time step at a time.

The output is factored into classes: the model's words by rank, CLASS_WORDS to a class, one class for all other words
and one for the end of a text. A word's probability is that of its class times that within its class. Within the
class of all other words it is left to the caller, who knows their counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

HIDDEN = 16
CLASS_WORDS = 64
#: Documents side by side, and time steps of a window, in training and in scoring.
TRAIN_LANES, TRAIN_STEPS = 512, 16
SCORE_LANES, SCORE_STEPS = 512, 32
#: Windows that a training batch is cut into at least, down to 32 lanes.
WINDOWS = 64
_NONE = np.float32(-1e4)  # the logit of a place of a class that no word has


@dataclass
class Gru:
    """Parameters live in one flat vector. Token ids: 0 .. n_words-1 by rank, then OTHER, then END (START as an input)."""

    n_words: int
    theta: np.ndarray = field(repr=False, default=None)

    def __post_init__(self):
        h, k = HIDDEN, self.n_words
        self.n_classes = -(-k // CLASS_WORDS)
        self.other, self.end = k, k + 1
        self.shapes = {"embed": (k + 2, h), "w": (h, 3 * h), "b": (3 * h,), "u": (h, 3 * h), "wc": (h + 1, self.n_classes + 2), "wo": (self.n_classes, h + 1, CLASS_WORDS)}  # the last row of each: biases
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        if self.theta is None:
            self.theta = np.zeros(self.size, np.float32)
        self.p = self.views(self.theta)
        self.class_of = np.minimum(np.arange(k + 2) // CLASS_WORDS, self.n_classes).astype(np.int16)
        self.class_of[self.other], self.class_of[self.end] = self.n_classes, self.n_classes + 1

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @classmethod
    def start(cls, counts: np.ndarray, n_other: float, n_end: float, seed: int = 7) -> Gru:
        """Small random weights, and biases that give the words' shares: the untrained model is the unigram model."""
        net = cls(len(counts))
        rng = np.random.default_rng(seed)
        for name, scale in (("embed", 0.3), ("w", 0.3), ("u", 0.2), ("wc", 0.02), ("wo", 0.02)):
            net.p[name][:] = rng.normal(0, scale, net.shapes[name])
        padded = np.zeros(net.n_classes * CLASS_WORDS)
        padded[: len(counts)] = counts + 1
        padded = padded.reshape(-1, CLASS_WORDS)
        with np.errstate(divide="ignore"):
            net.p["wo"][:, HIDDEN] = np.maximum(np.log(padded), _NONE) - np.log(padded.sum(1, keepdims=True))
        shares = np.append(padded.sum(1), [n_other + 1, n_end + 1])
        net.p["wc"][HIDDEN] = np.log(shares / shares.sum())
        return net

    def gates(self) -> np.ndarray:
        """What each token puts into the gates."""
        return self.p["embed"] @ self.p["w"] + self.p["b"]

    def run(self, h: np.ndarray, gates: np.ndarray, x: np.ndarray, fresh: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """Steps x (steps, lanes) from state h; where ``fresh``, a text begins and the state is 0. Returns all states, each with
        a 1 behind it, the last state, and what ``back`` needs."""
        u, d, kind = self.p["u"], HIDDEN, self.theta.dtype
        out = np.ones((*x.shape, d + 1), kind)
        before, zr_all, n_all, sn_all = (np.empty((*x.shape, w), kind) for w in (d, 2 * d, d, d)) if keep else (None,) * 4
        begins = fresh.any(1)
        for t in range(len(x)):
            if begins[t]:
                h = h * ~fresh[t][:, None]
            g, s = gates[x[t]], h @ u
            zr = g[:, : 2 * d]
            zr += s[:, : 2 * d]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, sn = zr[:, :d], zr[:, d:], s[:, 2 * d :]
            n = r * sn
            n += g[:, 2 * d :]
            np.tanh(n, out=n)
            if keep:
                before[t], zr_all[t], n_all[t], sn_all[t] = h, zr, n, sn
            h = h - n
            h *= z
            h += n
            out[t, :, :d] = h
        return out, h, (before, zr_all, n_all, sn_all) if keep else None

    def back(self, kept: tuple, x: np.ndarray, fresh: np.ndarray, d_out: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Adds the gradients of a window; the gradient ends where the window began."""
        (h, zr, n, sn), d = kept, HIDDEN
        z, r, ut = zr[..., :d], zr[..., d:], self.p["u"].T
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (h - n) * z * (1 - z), sn * r * (1 - r)
        d_state = np.empty((*x.shape, 3 * d), self.theta.dtype)  # by what the state puts into the gates
        d_n = np.empty_like(n)
        begins, carry = fresh.any(1), 0.0
        for t in range(len(x) - 1, -1, -1):
            dh = d_out[t] + carry
            dn, ds = d_n[t], d_state[t]
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dh, to_z[t], out=ds[:, :d])
            np.multiply(dn, to_r[t], out=ds[:, d : 2 * d])
            np.multiply(dn, r[t], out=ds[:, 2 * d :])
            dh *= z[t]
            carry = ds @ ut
            carry += dh
            if begins[t]:
                carry *= ~fresh[t][:, None]
        flat, ids = d_state.reshape(-1, 3 * d), x.ravel()
        grad["u"] += h.reshape(-1, d).T @ flat
        flat[:, 2 * d :] = d_n.reshape(-1, d)  # by what the token puts into them
        grad["b"] += flat.sum(0)
        grad["w"] += self.p["embed"][ids].T @ flat
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad["embed"][ids[first]] += np.add.reduceat(flat[order], first, axis=0) @ self.p["w"].T

    def _exp(self, logits: np.ndarray, bound: float) -> np.ndarray:
        """Exponentials in place, shifted only where they could overflow: a state is within -1 .. 1, which bounds the logits."""
        if bound > 60:
            logits -= logits.max(1, keepdims=True)
        return np.exp(logits, out=logits)

    def log_p(self, states: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ``target`` (within OTHER: of the class only). With ``grad``, adds the gradients of
        the cross entropy times ``weight``, and returns that of the states. All in order of class, so that each class is one run."""
        p, n, d = self.p, len(target), HIDDEN
        order = np.argsort(self.class_of[target], kind="stable")
        y, c, s = target[order], self.class_of[target[order]], states[order]
        at, edges = np.arange(n), np.searchsorted(c, np.arange(self.n_classes + 1))
        e = s @ p["wc"]
        own = e[at, c]
        shift = np.abs(p["wc"][:d]).sum(0).max() + p["wc"][d].max()
        if shift > 60:
            own = own - e.max(1)
        self._exp(e, shift)
        total = e @ np.ones(e.shape[1], e.dtype)
        out = own - np.log(total)
        d_states = None
        if grad is not None:
            share = weight[order].astype(e.dtype)
            e *= (share / total)[:, None]
            e[at, c] -= share
            grad["wc"] += s.T @ e
            d_states = e @ p["wc"][:d].T
        known = edges[-1]
        f = np.empty((known, CLASS_WORDS), e.dtype)
        for k in range(self.n_classes):
            if edges[k] < edges[k + 1]:
                np.matmul(s[edges[k] : edges[k + 1]], p["wo"][k], out=f[edges[k] : edges[k + 1]])
        word = y[:known] - c[:known].astype(np.int64) * CLASS_WORDS
        own = f[at[:known], word]
        shift = (np.abs(p["wo"][:, :d]).sum(1).max() + p["wo"][:, d].max()) if self.n_classes else 0.0
        if shift > 60:
            own = own - f.max(1)
        self._exp(f, shift)
        total = f @ np.ones(CLASS_WORDS, f.dtype)
        out[:known] += own - np.log(total)
        if grad is not None:
            f *= (share[:known] / total)[:, None]
            f[at[:known], word] -= share[:known]
            for k in range(self.n_classes):
                lo, hi = edges[k], edges[k + 1]
                if lo < hi:
                    grad["wo"][k] += s[lo:hi].T @ f[lo:hi]
                    d_states[lo:hi] += f[lo:hi] @ p["wo"][k, :d].T
            back = np.empty_like(d_states)
            back[order] = d_states
            d_states = back
        result = np.empty(n, out.dtype)
        result[order] = out
        return result, d_states


@dataclass
class Trainer:
    """Adam with truncated backpropagation through time."""

    net: Gru
    rate: float
    seen: int = 0
    step: int = 0

    def __post_init__(self):
        self.m, self.v, self.g = (np.zeros(self.net.size, np.float32) for _ in range(3))

    def learn(self, ids: np.ndarray, first: np.ndarray, weight: np.ndarray) -> None:
        """Texts one after the other, each with its END; ``first``: where each begins; ``weight`` of each token. They are cut into
        as many equal lanes as fit; a lane's state is carried from window to window, and the gradient ends with the window."""
        if not len(ids):
            return
        net = self.net
        # Few texts go side by side in fewer lanes, so that there are windows enough to learn from.
        lanes = min(max(len(ids) // (TRAIN_STEPS * WINDOWS), 32), TRAIN_LANES, -(-len(ids) // TRAIN_STEPS))
        length = -(-len(ids) // lanes)
        begins = np.zeros(len(ids), bool)
        begins[first[first < len(ids)]] = begins[0] = True
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[begins] = net.end
        pad = lanes * length - len(ids)
        lane = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(lanes, length).T
        x, y, fresh, counts = lane(before, net.end), lane(ids, net.end), lane(begins, True), lane(weight, 0)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for lo in range(0, length, TRAIN_STEPS):
            hi = lo + TRAIN_STEPS
            states, h, kept = net.run(h, net.gates(), x[lo:hi], fresh[lo:hi], True)
            self.g[:] = 0
            grad = net.views(self.g)
            share = (counts[lo:hi] / max(1, counts[lo:hi].sum())).astype(np.float32).ravel()
            _, d = net.log_p(states.reshape(-1, HIDDEN + 1), y[lo:hi].ravel(), grad, share)
            net.back(kept, x[lo:hi], fresh[lo:hi], d.reshape(*x[lo:hi].shape, HIDDEN), grad)
            self.update()
        self.seen += len(ids)

    def update(self) -> None:
        self.step += 1
        g, m, v = self.g, self.m, self.v
        m *= 0.9
        m += 0.1 * g
        g *= g
        v *= 0.99
        v += 0.01 * g
        top = m * np.float32(self.rate / (1 - 0.9**self.step))
        np.sqrt(v * np.float32(1 / (1 - 0.99**self.step)), out=g)
        g += 1e-8
        top /= g
        self.net.theta -= top


def _lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt to lanes, longest first, each to the shortest lane so far; the longest lane first."""
    heap = [(0, k) for k in range(max(1, min(most, len(lengths))))]
    own: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (n + int(lengths[i]), k))
    return sorted(own, key=lambda o: -sum(int(lengths[i]) for i in o))


def log_likelihoods(net: Gru, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log-likelihood of each text (within OTHER: of the class only). ``first``: where each begins, and the end.
    A text of any length runs through one lane, its state carried from window to window."""
    n = len(first) - 1
    out = np.zeros(n)
    if not n:
        return out
    lengths, gates = np.diff(first), net.gates()
    own = _lanes(lengths, SCORE_LANES)
    order = np.array([i for o in own for i in o])
    # In 32 bits, as a batch may hold millions of tokens.
    y = ids[np.repeat(first[:-1][order] - np.r_[0, np.cumsum(lengths[order])[:-1]], lengths[order]) + np.arange(len(ids))].astype(np.int32)
    doc = np.repeat(order.astype(np.int32), lengths[order])
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[fresh] = net.end
    size = np.array([lengths[o].sum() for o in own])
    lane_first = np.r_[0, np.cumsum(size)[:-1]]
    h = np.zeros((len(own), HIDDEN), np.float32)
    for lo in range(0, int(size[0]), SCORE_STEPS):
        live = int(np.searchsorted(-size, -lo, side="left"))  # lanes longer than lo
        steps = lo + np.arange(min(SCORE_STEPS, int(size[0]) - lo))[:, None]
        real = steps < size[:live]
        place = np.minimum(lane_first[:live] + steps, len(ids) - 1)
        states, h, _ = net.run(h[:live], gates, x[place], fresh[place], False)
        held = place[real]
        lp, _ = net.log_p(states[real], y[held])
        out += np.bincount(doc[held], weights=lp, minlength=n)
    return out


def packed(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Joins (ids, first with its end) of several chunks."""
    ids, first, n = [], [np.zeros(1, np.int64)], 0
    for a, f in rows:
        ids.append(a)
        first.append(f[1:] + n)
        n += len(a)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.concatenate(first)
