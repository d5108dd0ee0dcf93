"""A gated recurrent language model in numpy with a class-factored output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass
class Shape:
    """Words are numbered by falling count; word 0 ends a document, the last one stands for all other words."""

    words: int
    hidden: int
    #: First word of each class, then the number of words.
    edges: np.ndarray

    def __post_init__(self) -> None:
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.edges))

    @property
    def classes(self) -> int:
        return len(self.edges) - 1


def class_edges(counts: np.ndarray, classes: int) -> np.ndarray:
    """Cut the words into runs of about equal sums of the square roots of counts, at most `classes` of them. That keeps
    the mean size of a word's class, and so the work for a word, least. The last word has a class of its own."""
    total = np.cumsum(np.sqrt(counts[:-1] + 1.0))
    if not len(total):
        return np.array([0, len(counts)])
    cuts = np.searchsorted(total, total[-1] * np.arange(1, classes - 1) / (classes - 1)) + 1
    return np.unique(np.concatenate(([0], cuts[cuts < len(counts) - 1], [len(counts) - 1, len(counts)])))


def initial(shape: Shape, counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output biases give the words' relative counts."""
    rng, h = np.random.default_rng(seed), shape.hidden
    sizes = np.diff(shape.edges)
    log = np.log(counts + 1.0)
    log -= np.repeat(np.maximum.reduceat(log, shape.edges[:-1]), sizes)
    mass = np.log(np.add.reduceat(counts + 1.0, shape.edges[:-1]))
    return {
        "table": rng.normal(0, 0.1, (shape.words, 3 * h)).astype(F32),
        "u": rng.normal(0, h**-0.5, (h, 3 * h)).astype(F32),
        "b": np.concatenate((np.ones(h), np.zeros(2 * h))).astype(F32),
        "wc": rng.normal(0, 0.05, (h, shape.classes)).astype(F32),
        "bc": (mass - mass.max()).astype(F32),
        "wo": rng.normal(0, 0.05, (shape.words, h)).astype(F32),
        "bo": log.astype(F32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.negative(x)
    with np.errstate(over="ignore"):
        np.exp(e, out=e)
    e += F32(1)
    return np.reciprocal(e, out=e)


def _tanh(x: np.ndarray) -> np.ndarray:
    """By the exponential, which numpy has vectorised for single precision."""
    return F32(2) * _sigmoid(F32(2) * x) - F32(1)


def _step(ut: np.ndarray, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next states from the words' part `a` of the gates and the states `h`; also gates and what their gradients
    need. A column for each stream, so that each gate is one block of memory."""
    n = len(h)
    c = ut @ h
    zr = _sigmoid(a[: 2 * n] + c[: 2 * n])
    z, r, cm = zr[:n], zr[n:], c[2 * n :]
    m = _tanh(a[2 * n :] + r * cm)
    return m + z * (h - m), z, r, m, cm


def _log_softmax_at(logits: np.ndarray, at: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of the entry at `at` in each row, and all probabilities if they are wanted. Logits are mostly
    small, so the row's maximum is taken off only where exponentials overflow or vanish."""
    rows, ones = np.arange(len(at)), np.ones(logits.shape[1], logits.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ ones
    if not (np.isfinite(total).all() and total.all()):
        logits = logits - logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e @ ones
    out = logits[rows, at] - np.log(total)
    if not wanted:
        return out, None
    e *= (1 / total)[:, None]
    return out, e


def log_probabilities(p: dict[str, np.ndarray], shape: Shape, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log P(word) = log P(class) + log P(word in class) for each row; with grads also d loss / d h."""
    kind = shape.class_of[y]
    wanted = grads is not None
    out, prob = _log_softmax_at(h @ p["wc"] + p["bc"], kind, wanted)
    dh = None
    if wanted:
        prob[np.arange(len(y)), kind] -= 1
        grads["wc"] += h.T @ prob
        grads["bc"] += prob.sum(axis=0)
        dh = prob @ p["wc"].T
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(shape.classes + 1))
    sorted_h, sorted_y, part_of = h[order], y[order], np.zeros(len(y), out.dtype)
    sorted_dh = np.zeros_like(sorted_h) if wanted else None
    for c in np.flatnonzero(np.diff(bounds)):
        s, e = shape.edges[c], shape.edges[c + 1]
        if e - s == 1:
            continue
        a, b = bounds[c], bounds[c + 1]
        hs, at = sorted_h[a:b], sorted_y[a:b] - s
        logits = hs @ p["wo"][s:e].T
        logits += p["bo"][s:e]
        part_of[a:b], prob = _log_softmax_at(logits, at, wanted)
        if wanted:
            prob[np.arange(b - a), at] -= 1
            grads["wo"][s:e] += prob.T @ hs
            grads["bo"][s:e] += prob.sum(axis=0)
            np.matmul(prob, p["wo"][s:e], out=sorted_dh[a:b])
    out[order] += part_of
    if wanted:
        dh[order] += sorted_dh
    return out, dh


def _streams(docs: list[np.ndarray], streams: int, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Inputs and goals, a row for each place and a column for each stream: documents end to end, cut into equal parts.
    Places past the last token have goal -1."""
    text = np.concatenate([np.zeros(1, np.int32), *(np.append(d, 0).astype(np.int32) for d in docs)])
    tokens = len(text) - 1
    streams = max(1, min(streams, tokens // window))
    each = -(-tokens // streams)
    x, y = np.zeros(streams * each, np.int32), np.full(streams * each, -1, np.int32)
    x[:tokens], y[:tokens] = text[:-1], text[1:]
    return np.ascontiguousarray(x.reshape(streams, each).T), np.ascontiguousarray(y.reshape(streams, each).T), tokens


def window_gradients(p: dict[str, np.ndarray], shape: Shape, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], float]:
    """Back-propagation through one window of places (rows) and streams (columns) from the states h (a column for each
    stream): the states at its end, gradients of the loss (sum of negative log probabilities) and the loss."""
    steps, wide = x.shape
    n = shape.hidden
    inputs = np.ascontiguousarray((p["table"] + p["b"])[x].transpose(0, 2, 1))
    open_ = (x != 0).astype(h.dtype)
    ut, u = np.ascontiguousarray(p["u"].T), p["u"]
    before, states = np.empty((steps, n, wide), h.dtype), np.empty((steps, n, wide), h.dtype)
    kept = []
    for t in range(steps):
        np.multiply(h, open_[t], out=before[t])
        h, *rest = _step(ut, inputs[t], before[t])
        states[t] = h
        kept.append(rest)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    use = y >= 0
    after = np.zeros((steps, wide, n), h.dtype)
    logs, after[use] = log_probabilities(p, shape, states.transpose(0, 2, 1)[use], y[use], grads)
    after = np.ascontiguousarray(after.transpose(0, 2, 1))
    da, dc = np.empty_like(inputs), np.empty_like(inputs)
    carry = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        z, r, m, cm = kept[t]
        dh = after[t] + carry
        keep = 1 - z
        dz = dh * keep
        dm = dz * (1 - m * m)
        dz *= z
        dz *= before[t] - m
        da[t, :n] = dc[t, :n] = dz
        dr = dm * cm
        dr *= r
        dr *= 1 - r
        da[t, n : 2 * n] = dc[t, n : 2 * n] = dr
        da[t, 2 * n :] = dm
        np.multiply(dm, r, out=dc[t, 2 * n :])
        dh *= z
        dh += u @ dc[t]
        carry = dh * open_[t]
    grads["u"] = np.tensordot(before, dc, ((0, 2), (0, 2)))
    da, at = da.transpose(0, 2, 1).reshape(-1, 3 * n), x.ravel()
    order = np.argsort(at, kind="stable")
    found = at[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    grads["table"][found[first]] = np.add.reduceat(da[order], first, axis=0)
    grads["b"] = grads["table"].sum(axis=0)
    return h, grads, -float(logs.sum())


def train(p: dict[str, np.ndarray], shape: Shape, docs: list[np.ndarray], streams: int = 512, window: int = 32, rate: float = 0.03) -> tuple[dict[str, np.ndarray], int]:
    """One pass of truncated backpropagation: documents are laid end to end in parallel streams; the state goes on from
    window to window and is cleared where a document begins. Returns new weights and the number of tokens."""
    p = {k: v.copy() for k, v in p.items()}
    x, y, tokens = _streams(docs, streams, window)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    h, turn, turns = np.zeros((shape.hidden, x.shape[1]), F32), 0, -(-len(x) // window)
    for at in range(0, len(x), window):
        goal = y[at : at + window]
        if not (goal >= 0).any():
            break
        h, grads, _ = window_gradients(p, shape, x[at : at + window], goal, h)
        turn += 1
        scale = F32(1 / max(1, int((goal >= 0).sum())))
        step = rate * min(1.0, turn / 20) * max(0.1, 1 - turn / turns)
        step = F32(step * (1 - 0.99**turn) ** 0.5 / (1 - 0.9**turn))
        for k, g in grads.items():
            g *= scale
            mean[k] += F32(0.1) * (g - mean[k])
            square[k] += F32(0.01) * (g * g - square[k])
            p[k] -= step * mean[k] / (np.sqrt(square[k]) + F32(1e-6))
    return p, tokens


def score(p: dict[str, np.ndarray], shape: Shape, docs: list[np.ndarray], window: int = 32, together: int = 8192, held: int = 1 << 14) -> np.ndarray:
    """Natural log probability of each whole document with its end; the state is carried from window to window.

    Documents are taken by falling length, `together` at a time; in each window only those that are not over yet stay.
    """
    total = np.zeros(len(docs))
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    table, ut = p["table"] + p["b"], np.ascontiguousarray(p["u"].T)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal waiting, size
        if waiting:
            h, y, who = (np.concatenate(v, axis=-1) for v in zip(*waiting, strict=True))
            total[:] += np.bincount(who, log_probabilities(p, shape, np.ascontiguousarray(h.T), y)[0].astype(np.float64), len(docs))
            waiting, size = [], 0

    for at in range(0, len(docs), together):
        mine = order[at : at + together]
        long = lengths[mine]
        ends = np.cumsum(long)
        text = np.zeros(int(ends[-1]), np.int32)
        for i, e in zip(mine, ends, strict=True):
            text[e - lengths[i] : e - 1] = docs[i]
        first = ends - long
        h, before = np.zeros((shape.hidden, len(mine)), F32), np.zeros(len(mine), np.int32)
        live_at = np.searchsorted(-long, -np.arange(int(long[0])), side="left")
        for t in range(int(long[0])):
            live = int(live_at[t])
            h = _step(ut, np.ascontiguousarray(table[before[:live]].T), h[:, :live])[0]
            before = text[first[:live] + t]
            waiting.append((h, before, mine[:live]))
            size += live
            if size >= held:
                flush()
    flush()
    return total
