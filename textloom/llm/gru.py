"""A gated recurrent word model with a class-factored softmax, in numpy.

A document is read as end, w1 .. wn and predicts w1 .. wn, end. Documents lie end to end in lanes that advance together;
the state starts at zero for each document and is carried from window to window to its end, so the log-likelihood is that
of the complete document. Training is truncated backpropagation: gradients stop at a window's start, the state doesn't.
Lanes are ragged, so memory follows the number of tokens, whatever the longest document's length.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END, UNK = 0, 1


#: Tokens whose outputs are worked on at once, so that they stay in a core's cache.
PART = 2048


def softmax(w: np.ndarray, b: np.ndarray, x: np.ndarray, at: np.ndarray, columns: np.ndarray, safe: bool) -> tuple[np.ndarray, ...]:
    """Exponentials and their sums, one column for each column of x, and ln of the share of the one at `at`. safe: no sum of weights can overflow."""
    e = w.T @ x
    e += b[:, None]
    if not safe:
        e -= e.max(0)
    got = e[at, columns]
    np.exp(e, out=e)
    total = e.sum(0)
    return e, total, got - np.log(total)


def lanes_for(docs: list[np.ndarray], most: int) -> int:
    """As many lanes as the longest document leaves about equally long."""
    total, longest = sum(map(len, docs)), max(map(len, docs), default=1)
    return max(min(64, most), min(most, total // max(1, longest)))


@dataclass
class Lanes:
    """Documents dealt to lanes, longest lane first: flat inputs, targets, document of each token, and starts of documents."""

    begin: np.ndarray
    length: np.ndarray
    inputs: np.ndarray
    target: np.ndarray
    of: np.ndarray
    fresh: np.ndarray

    @classmethod
    def deal(cls, docs: list[np.ndarray], lanes: int) -> Lanes:
        """Long documents are dealt first, each to the shortest lane, and lie there in the order they came in."""
        heap = [(0, i) for i in range(max(1, min(lanes, len(docs))))]
        own: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, i = heapq.heappop(heap)
            own[i].append(d)
            heapq.heappush(heap, (n + len(docs[d]), i))
        length = np.array([sum(len(docs[d]) for d in o) for o in own], np.int64)
        by_length = np.argsort(-length, kind="stable")
        length = length[by_length]
        order = [d for i in by_length.tolist() for d in sorted(own[i])]
        sizes = np.array([len(docs[d]) for d in order], np.int64)
        target = np.concatenate([docs[d] for d in order]).astype(np.int32) if order else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        inputs = np.empty_like(target)
        inputs[1:] = target[:-1]
        fresh = np.zeros(len(target), bool)
        inputs[starts], fresh[starts] = END, True
        return cls(np.cumsum(length) - length, length, inputs, target, np.repeat(np.array(order, np.int32), sizes), fresh)

    def windows(self, size: int):
        """(place of each token by step and lane, whether there is one) of each window; ended lanes are left out."""
        longest = int(self.length[0]) if len(self.length) else 0
        for a in range(0, longest, size):
            live = int(np.searchsorted(-self.length, -a))
            steps = np.arange(a, min(a + size, longest))[:, None]
            there = steps < self.length[:live]
            yield np.where(there, self.begin[:live] + steps, self.begin[:live]), there


def some(states: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The states, by step and lane, of places that hold a token."""
    return states.reshape(len(states), -1) if there.all() else states[:, there]


def class_starts(mass: np.ndarray, limit: float) -> np.ndarray:
    """First words of classes, and the end. Words stand in order of frequency; a class closes before its share of the tokens times its size passes `limit`, so frequent words stand in small classes."""
    starts, share = [0], 0.0
    for i, x in enumerate((mass / mass.sum()).tolist()):
        if i > starts[-1] and (share + x) * (i + 1 - starts[-1]) > limit:
            starts.append(i)
            share = 0.0
        share += x
    return np.array([*starts, len(mass)])


class Model:
    """counts: of the vocabulary's words, whose numbers are their places; after the first two, most frequent first."""

    names = ("emb", "wx", "wh", "b", "wc", "bc", "wo", "bo")

    def __init__(self, counts: np.ndarray, hidden: int = 24, width: int = 16, limit: float = 1.0, seed: int = 7):
        self.hidden, self.width = hidden, width
        n, mass = len(counts), np.asarray(counts, float)
        self.starts = class_starts(mass, limit)
        self.classes = len(self.starts) - 1
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.uint16), np.diff(self.starts))
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        self.emb, self.wx, self.wh = f(n, width), f(width, 3 * hidden, scale=0.3), f(hidden, 3 * hidden, scale=0.2)
        self.b = np.zeros(3 * hidden, np.float32)
        by_class = np.add.reduceat(mass, self.starts[:-1])
        # output biases start at the unigram model, so training begins there
        self.wc, self.bc = np.zeros((hidden, self.classes), np.float32), np.log(by_class / mass.sum()).astype(np.float32)
        self.wo, self.bo = np.zeros((hidden, n), np.float32), np.log(mass / by_class[self.class_of]).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.names:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size

    def step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates r and z, candidate, its recurrent part), one column a lane."""
        k = self.hidden
        gh = self.wh.T @ h
        rz = gx[: 2 * k] + gh[: 2 * k]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        n = rz[:k] * gh[2 * k :]
        n += gx[2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= rz[k:]
        new += n
        return new, rz, n, gh[2 * k :]

    def outputs(self, h: np.ndarray, target: np.ndarray, back: bool = False) -> tuple:
        """ln p(target | state) of each column of h; with back, also gradients of the mean negative log-likelihood."""
        own = self.class_of[target]
        order = np.argsort(own, kind="stable")
        x, t, cls = h.take(order, 1), target[order], own[order]
        n = len(order)
        out = np.empty(n, x.dtype)
        one = x.dtype.type(1 / max(1, n))
        grads = {k: np.zeros_like(getattr(self, k)) for k in ("wc", "bc", "wo", "bo")} if back else {}
        dh = np.empty_like(x) if back else x
        columns = np.arange(min(n, PART))
        # states lie within -1 and 1, so a logit is at most the sum of its weights' sizes and its bias
        safe = max(float((np.abs(w).sum(0) + bias).max()) for w, bias in ((self.wc, self.bc), (self.wo, self.bo))) < 60

        def part(w: np.ndarray, bias: np.ndarray, a: int, b: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
            e, total, got = softmax(w, bias, x[:, a:b], at, columns[: b - a], safe)
            if back:
                e *= one / total
                e[at, columns[: b - a]] -= one
            return e, got

        for a in range(0, n, PART):
            b = min(a + PART, n)
            e, out[a:b] = part(self.wc, self.bc, a, b, cls[a:b])
            if back:
                grads["wc"] += x[:, a:b] @ e.T
                grads["bc"] += e.sum(1)
                np.matmul(self.wc, e, out=dh[:, a:b])
        stops = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        for c, (low, high) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            if high == low + 1:
                continue  # a word alone in its class is certain
            w, bias = self.wo[:, low:high], self.bo[low:high]
            for a in range(stops[c], stops[c + 1], PART):
                b = min(a + PART, stops[c + 1])
                e, got = part(w, bias, a, b, t[a:b] - low)
                out[a:b] += got
                if back:
                    grads["wo"][:, low:high] += x[:, a:b] @ e.T
                    grads["bo"][low:high] += e.sum(1)
                    dh[:, a:b] += w @ e
        placed = np.empty_like(out)
        placed[order] = out
        if not back:
            return (placed,)
        back_h = np.empty_like(h)
        back_h[:, order] = dh
        return placed, back_h, grads

    def score(self, docs: list[np.ndarray], lanes: int | None = None, window: int = 64) -> np.ndarray:
        """ln of each document's probability; docs are word numbers with the end last."""
        dealt = Lanes.deal(docs, lanes or lanes_for(docs, 512))
        table = self.emb @ self.wx + self.b
        out = np.zeros(len(docs))
        h = np.zeros((self.hidden, len(dealt.length)), np.float32)
        for at, there in dealt.windows(window):
            h = np.ascontiguousarray(h[:, : at.shape[1]])
            fresh = dealt.fresh[at]
            starts = fresh.any(1).tolist()
            gx = np.ascontiguousarray(table[dealt.inputs[at]].transpose(0, 2, 1))
            states = np.empty((self.hidden, *at.shape), np.float32)
            for t in range(len(at)):
                if starts[t]:
                    h[:, fresh[t]] = 0
                h = self.step(gx[t], h)[0]
                states[:, t] = h
            i = at[there]
            got = self.outputs(some(states, there), dealt.target[i])[0]
            out += np.bincount(dealt.of[i], got, len(docs))
        return out

    def train(self, docs: list[np.ndarray], lanes: int | None = None, window: int = 32, rate: float = 0.01, state: dict | None = None) -> dict:
        """Adam steps over the documents once, one step a window. A window that few lanes reach moves the weights by its share of a full one."""
        state = state or {"t": 0} | {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.names}
        dealt = Lanes.deal(docs, lanes or lanes_for(docs, 256))
        h = np.zeros((self.hidden, len(dealt.length)), self.wh.dtype)
        full = min(window, int(dealt.length[0]) if len(dealt.length) else 0) * len(dealt.length)
        for at, there in dealt.windows(window):
            h, grads = self.gradients(dealt.inputs[at], dealt.target[at], there, dealt.fresh[at], np.ascontiguousarray(h[:, : at.shape[1]]))[1:]
            self.move(grads, rate, state, there.sum() / full)
        return state

    def gradients(self, ids, target, there, fresh, h) -> tuple[float, np.ndarray, dict]:  # noqa: ANN001
        """Mean negative log-likelihood of a window, the state behind it, and the gradients of the weights."""
        k, (steps, lanes) = self.hidden, ids.shape
        kind = self.wh.dtype
        by_step = lambda x: x.reshape(steps, lanes, -1).transpose(0, 2, 1)
        by_token = lambda x: x.transpose(0, 2, 1).reshape(steps * lanes, -1)
        x = self.emb[ids.ravel()]
        gx = np.ascontiguousarray(by_step(x @ self.wx + self.b))
        before, ns, ghn = (np.empty((steps, k, lanes), kind) for _ in range(3))
        states, rz = np.empty((k, steps, lanes), kind), np.empty((steps, 2 * k, lanes), kind)
        starts = fresh.any(1).tolist()
        for t in range(steps):
            if starts[t]:
                h = h.copy()
                h[:, fresh[t]] = 0
            before[t] = h
            h, rz[t], ns[t], ghn[t] = self.step(gx[t], h)
            states[:, t] = h
        got, dout, grads = self.outputs(some(states, there), target[there], True)
        if there.all():
            dstates = dout.reshape(states.shape)
        else:
            dstates = np.zeros_like(states)
            dstates[:, there] = dout
        r, z = rz[:, :k], rz[:, k:]
        to_n = (1 - z) * (1 - ns * ns)
        to_z = (before - ns) * z * (1 - z)
        to_r = ghn * r * (1 - r)
        dg, dgh = np.empty((steps, 3 * k, lanes), kind), np.empty((steps, 3 * k, lanes), kind)
        dh = np.zeros((k, lanes), kind)
        for t in range(steps - 1, -1, -1):
            dh += dstates[:, t]
            dn = np.multiply(dh, to_n[t], out=dg[t, 2 * k :])
            np.multiply(dh, to_z[t], out=dg[t, k : 2 * k])
            np.multiply(dn, to_r[t], out=dg[t, :k])
            dgh[t, : 2 * k] = dg[t, : 2 * k]
            np.multiply(dn, r[t], out=dgh[t, 2 * k :])
            dh *= z[t]
            dh += self.wh @ dgh[t]
            if starts[t]:
                dh[:, fresh[t]] = 0
        dg, dgh = by_token(dg), by_token(dgh)
        grads |= {"wx": x.T @ dg, "b": dg.sum(0), "wh": by_token(before).T @ dgh, "emb": np.zeros_like(self.emb)}
        order = np.argsort(ids.ravel(), kind="stable")
        own = ids.ravel()[order]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        grads["emb"][own[head]] = np.add.reduceat((dg @ self.wx.T)[order], head, axis=0)
        return -float(got.mean()), h, grads

    def move(self, grads: dict, rate: float, state: dict, share: float = 1.0) -> None:
        state["t"] += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = share * min(1.0, 1.0 / (norm + 1e-9))
        up, root = rate / (1 - 0.9 ** state["t"]), 1 / np.sqrt(1 - 0.999 ** state["t"])
        for name, g in grads.items():
            m, v = state[name]
            g *= g.dtype.type(clip)
            m *= m.dtype.type(0.9)
            m += m.dtype.type(0.1) * g
            v *= v.dtype.type(0.999)
            g *= g
            g *= g.dtype.type(0.001)
            v += g
            np.sqrt(v, out=g)
            g *= g.dtype.type(root)
            g += g.dtype.type(1e-6)
            np.divide(m, g, out=g)
            g *= g.dtype.type(up)
            getattr(self, name)[...] -= g
