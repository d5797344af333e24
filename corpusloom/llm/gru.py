"""Gated recurrent language model in NumPy: class-factored softmax, truncated backpropagation, state carried across windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Steps of a window, documents side by side, and words of documents taken together at most.
STEPS, LANES, MOST_TOKENS = 48, 128, 4 << 20
#: Adam's step size and decay rates, the longest gradient, and how far input weights start from zero.
RATE, FIRST, SECOND, LONGEST, SPREAD = 0.01, 0.9, 0.99, 5.0, 0.1

Weights = dict[str, np.ndarray]


class Layout:
    """Numbers of ids: words of the model (ordered by class), then one id for each class of rare words.

    ``starts`` are the first words of the model's classes and their end. Each class of rare words is a class of the output too; what a
    rare word has inside its class comes from counts and is added outside.
    """

    def __init__(self, starts: np.ndarray, rare: int, hidden: int):
        self.starts, self.rare, self.hidden = np.asarray(starts, dtype=np.int64), rare, hidden
        self.words = int(self.starts[-1])
        self.classes = len(starts) - 1 + rare
        own = np.repeat(np.arange(len(starts) - 1), np.diff(self.starts))
        self.class_of = np.concatenate([own, len(starts) - 1 + np.arange(rare)]).astype(np.int64)

    def begin(self, counts: np.ndarray, seed: int = 7) -> Weights:
        """Weights that give the shares of ``counts`` (by id) whatever the state, and a small random recurrence."""
        rng, h, mass = np.random.default_rng(seed), self.hidden, counts + 0.5
        by_class = np.bincount(self.class_of, weights=mass, minlength=self.classes)
        return {k: v.astype(np.float32) for k, v in {
            "input": rng.normal(0, SPREAD, (self.words + self.rare, h)), "gate": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "gate_bias": np.zeros(3 * h),
            "state": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "class": np.zeros((h, self.classes)), "class_bias": np.log(by_class / by_class.sum()), "word": np.zeros((self.words, h)), "word_bias": np.log(mass[: self.words]),
        }.items()}


def _shares(scores: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of each column, written over ``scores``, and the logarithm of its divisor. Reductions run down the rows, whole vectors at a time.

    If not ``whole``, only the divisor is of use.
    """
    most = scores.max(axis=0)
    scores -= most
    np.exp(scores, out=scores)
    total = scores.sum(axis=0)
    if whole:
        scores /= total
    return scores, np.log(total) + most


def _entry(w: Weights) -> np.ndarray:
    """What each id gives to the gates, gate by gate."""
    return _by_gate(w["input"] @ w["gate"] + w["gate_bias"])


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Columns of the three gates one after another, so that what is done to one runs over whole vectors."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, -1).transpose(1, 0, 2))


def _window(lay: Layout, w: Weights, state: np.ndarray, x: np.ndarray, y: np.ndarray, live: np.ndarray, learn: bool):
    """One window: ``x`` before ``y``, steps by lanes. Returns natural logarithms (0 where not ``live``), the last state and gradients."""
    h, (steps, lanes) = lay.hidden, x.shape
    entry = w["entry"] if "entry" in w else _entry(w)
    states = np.empty((steps + 1, lanes, h), dtype=w["state"].dtype)
    states[0] = state
    kept = steps if learn else 1  # what only the way back reads is written over when there is none
    gates, (news, pulls) = np.empty((2, kept, lanes, h), dtype=states.dtype), (np.empty((kept, lanes, h), dtype=states.dtype) for _ in range(2))
    given, a = (np.empty((3, lanes, h), dtype=states.dtype) for _ in range(2))
    across = _by_gate(w["state"])
    for t in range(steps):
        at = t if learn else 0
        np.take(entry, x[t], axis=1, out=given, mode="clip")  # ids are known to lie inside; without the check no copy is made
        np.matmul(states[t], across, out=a)
        g = np.add(given[:2], a[:2], out=gates[:, at])
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        if learn:
            pulls[t] = a[2]
        new = np.multiply(g[1], a[2], out=news[at])
        new += given[2]
        np.tanh(new, out=new)
        next_ = np.subtract(states[t], new, out=states[t + 1])
        next_ *= g[0]
        next_ += new
    full = bool(live.all())
    flat, target = (states[1:].reshape(-1, h), y.ravel()) if full else (states[1:][live], y[live])
    kind, at = lay.class_of[target], np.arange(len(target))
    scores = w["class"].T @ flat.T
    scores += w["class_bias"][:, None]
    own = scores[kind, at]
    share, divisor = _shares(scores, learn)
    logs = own - divisor
    order = np.flatnonzero(target < lay.words)
    order = order[np.argsort(kind[order].astype(np.uint16), kind="stable")]  # small numbers sort fast
    cuts = np.searchsorted(kind[order], np.arange(len(lay.starts)))
    grad, back = None, None
    if learn:
        share[kind, at] -= 1
        back = share.T @ w["class"].T
        grad = {k: np.zeros_like(v) for k, v in w.items() if k in ("input", "word", "word_bias")}
        grad |= {"class": (share @ flat).T, "class_bias": share.sum(axis=1)}
    flats, targets, more = flat[order], target[order], np.zeros(len(order), dtype=states.dtype)
    backs = np.zeros_like(flats) if learn else None
    for c in np.flatnonzero(np.diff(cuts)):
        low, high = lay.starts[c], lay.starts[c + 1]
        if high - low == 1:
            continue
        rows = slice(cuts[c], cuts[c + 1])
        f, t, word = flats[rows], targets[rows] - low, w["word"][low:high]
        near = word @ f.T
        near += w["word_bias"][low:high, None]
        here = np.arange(len(t))
        own = near[t, here]
        part, divisor = _shares(near, learn)
        more[rows] = own - divisor
        if learn:
            part[t, here] -= 1
            np.matmul(part.T, word, out=backs[rows])
            np.matmul(part, f, out=grad["word"][low:high])
            grad["word_bias"][low:high] = part.sum(axis=1)
    logs[order] += more
    if learn:
        back[order] += backs
    out = np.zeros(x.shape)
    out[live] = logs
    if not learn:
        return out, states[-1], None
    deltas = back.reshape(steps, lanes, h) if full else np.zeros((steps, lanes, h), dtype=np.float32)
    if not full:
        deltas[live] = back
    # What does not depend on later steps, for all steps at once: how far each gate passes a change of the state on.
    z, r = gates
    keep = 1 - z
    to_new = 1 - news * news
    to_new *= keep
    to_z = states[:-1] - news
    to_z *= z
    to_z *= keep
    to_r = 1 - r
    to_r *= r
    to_r *= pulls
    by_z, by_r, by_new = (np.empty((steps, lanes, h), dtype=states.dtype) for _ in range(3))
    later, step, pulled = (np.zeros((lanes, h), dtype=states.dtype) for _ in range(3))
    across_z, across_r, across_new = (np.ascontiguousarray(k.T) for k in across)
    for t in range(steps - 1, -1, -1):
        later += deltas[t]
        np.multiply(later, to_z[t], out=by_z[t])
        new = np.multiply(later, to_new[t], out=by_new[t])
        np.multiply(new, to_r[t], out=by_r[t])
        np.multiply(new, r[t], out=pulled)
        later *= z[t]
        for d, back_to in ((by_z[t], across_z), (by_r[t], across_r), (pulled, across_new)):
            later += np.matmul(d, back_to, out=step)
    before = states[:-1].reshape(-1, h).T
    flat_z, flat_r, flat_new = (d.reshape(-1, h) for d in (by_z, by_r, by_new))
    grad["state"] = np.concatenate([before @ flat_z, before @ flat_r, before @ (flat_new * r.reshape(-1, h))], axis=1)
    into = np.concatenate([flat_z, flat_r, flat_new], axis=1)
    seen = x.ravel().astype(np.uint16)  # small numbers sort fast
    order = np.argsort(seen, kind="stable")
    first = np.flatnonzero(np.diff(seen[order].astype(np.int64), prepend=-1))
    grad["gate"], grad["gate_bias"] = w["input"][seen].T @ into, into.sum(axis=0)
    grad["input"][seen[order][first]] = np.add.reduceat((into @ w["gate"].T)[order], first, axis=0)
    return out, states[-1], grad


def documents(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of documents to lie side by side, about ``LANES``, the longest first, so that all of a group end at about the same step."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    most, held, size = -(-len(order) // max(1, round(len(order) / LANES))), [], 0
    for i in order:
        if held and (len(held) == most or size + len(texts[i]) > MOST_TOKENS):
            yield held
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held


def run(lay: Layout, w: Weights, texts: list[np.ndarray], learn: "Optimizer | None" = None) -> np.ndarray:
    """Natural logarithm of the probability of each whole document (a run of ids that ends in id 0), state carried from window to window.

    With an optimizer the weights move after each window, along the gradient that stops at the window's beginning.
    """
    total = np.zeros(len(texts))
    if learn is None:
        w = {**w, "entry": _entry(w)}
    for group in documents(texts):
        sizes = np.array([len(texts[i]) for i in group])
        state = np.zeros((len(group), lay.hidden), dtype=np.float32)
        before = np.zeros(len(group), dtype=np.int64)  # a document begins after an end
        for begin in range(0, int(sizes.max(initial=0)), STEPS):
            lanes = int((sizes > begin).sum())
            steps = int(min(STEPS, sizes[0] - begin))
            y, live = np.zeros((steps, lanes), dtype=np.int64), np.zeros((steps, lanes), dtype=bool)
            for lane in range(lanes):
                part = texts[group[lane]][begin : begin + steps]
                y[: len(part), lane], live[: len(part), lane] = part, True
            x = np.concatenate([before[None, :lanes], y[:-1]])
            logs, state, grad = _window(lay, w, state[:lanes], x, y, live, learn is not None)
            before = y[-1]
            total[group[:lanes]] += logs.sum(axis=0)
            if learn is not None:
                learn.step(w, grad, int(live.sum()))
    return total


class Optimizer:
    """Adam over all weights, gradients held to a length."""

    def __init__(self, w: Weights, rate: float = RATE):
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.rate, self.count, self.tokens = rate, 0, 0

    def step(self, w: Weights, grad: Weights, tokens: int) -> None:
        self.count += 1
        self.tokens += tokens
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / tokens
        scale = min(1.0, LONGEST / max(size, 1e-12)) / tokens
        rate = self.rate * np.sqrt(1 - SECOND**self.count) / (1 - FIRST**self.count)
        for k, g in grad.items():
            g *= scale
            m, s = self.mean[k], self.square[k]
            m *= FIRST
            m += (1 - FIRST) * g
            s *= SECOND
            g *= g
            g *= 1 - SECOND
            s += g
            np.sqrt(s, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate
            w[k] -= g
