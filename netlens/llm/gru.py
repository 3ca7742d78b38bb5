"""A gated recurrent language model in numpy with a class-factored output softmax.

Ids are symbols: frequent words by falling count, then symbols that each stand for many rarer words
(see ``scoring``). Ids of one class are neighbours in that order, so P(id) = P(class) P(id | class) costs
two softmaxes of about the square root of their number. Documents run in lanes: each lane is a queue of
whole documents, the state is carried from window to window and set to zero where a document begins.
"""

import heapq

import numpy as np

OUTPUTS, CLASS = 1024, 32
CLASSES = OUTPUTS // CLASS
HIDDEN = 16
#: Steps of a window of training; and the most of one of scoring, where windows grow as lanes end, for as many tokens.
WINDOW, LONGEST_WINDOW = 32, 1024
START = 0
CLIP = 1.0

SHAPES = {
    "inputs": (OUTPUTS, 3 * HIDDEN),
    "state": (HIDDEN, 3 * HIDDEN),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "words": (CLASSES, HIDDEN, CLASS),
    "word_bias": (CLASSES, CLASS),
}
LENGTH = sum(int(np.prod(s)) for s in SHAPES.values())


def unpacked(vector: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one vector of all parameters."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = vector[at : at + n].reshape(shape)
        at += n
    return out


def start_vector(counts: np.ndarray) -> np.ndarray:
    """Small pseudorandom weights; biases give the unigram distribution of ``counts`` (one for each id)."""
    rng = np.random.default_rng(7)
    vector = np.zeros(LENGTH, np.float32)
    p = unpacked(vector)
    for name in ("inputs", "state", "classes", "words"):
        p[name][...] = rng.standard_normal(p[name].shape) * 0.1
    # Ids that stand for no word have next to no mass.
    shares = (np.maximum(counts, 1e-6) / np.maximum(counts, 1e-6).sum()).reshape(CLASSES, CLASS)
    p["class_bias"][...] = np.log(shares.sum(axis=1))
    p["word_bias"][...] = np.log(shares / shares.sum(axis=1, keepdims=True))
    return vector


class Lanes:
    """Documents laid out in lanes, longest lane first: ``ids``, ``keep`` (0 where a document begins) and ``doc`` by (step, lane), and the lanes in use at each step."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        heap = [(0, k) for k in range(min(lanes, len(docs)))]
        queues: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, k = heapq.heappop(heap)
            queues[k].append(d)
            heapq.heappush(heap, (n + len(docs[d]), k))
        lengths = np.zeros(len(queues), np.int64)
        for n, k in heap:
            lengths[k] = n
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max(initial=0))
        self.ids = np.zeros((steps, len(queues)), np.int16)
        self.doc = np.zeros((steps, len(queues)), np.int32)
        self.keep = np.ones((steps, len(queues)), np.float32)
        for lane, k in enumerate(order):
            at = 0
            for d in queues[k]:
                n = len(docs[d])
                self.ids[at : at + n, lane] = docs[d]
                self.doc[at : at + n, lane] = d
                self.keep[at, lane] = 0
                at += n
        self.active = (lengths[order][None, :] > np.arange(steps)[:, None]).sum(axis=1) if steps else np.zeros(0, np.int64)

    def used(self, a: int, b: int, n: int):
        """Which of the window's places hold tokens: a mask, or all of it without a copy."""
        if self.active[b - 1] == n:
            return slice(None)
        return np.arange(n)[None, :] < self.active[a:b, None]

    def windows(self, longest: int = WINDOW):
        """(first step, end, lanes in use) of each window."""
        at, steps = 0, len(self.active)
        while at < steps:
            lanes = int(self.active[at])
            end = min(at + min(WINDOW * max(1, self.ids.shape[1] // lanes), longest), steps)
            yield at, end, lanes
            at = end


def run_window(p: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray):
    """States of each step, the last one, and what the way back needs: (before, candidate's product, gates).

    Lanes are the last axis of all of them, so that reset, update and candidate are stretches of one product.
    """
    H, (steps, lanes) = HIDDEN, x.shape
    # sigmoid(x) is (tanh(x / 2) + 1) / 2; the halves of x are taken from the weights.
    half = np.repeat(np.array([0.5, 1], np.float32), [2 * H, H])
    weights = np.ascontiguousarray((p["state"] * half).T)
    gates = np.ascontiguousarray(np.take(p["inputs"] * half, x, axis=0).transpose(0, 2, 1))
    states, befores, products = (np.empty((steps, H, lanes), np.float32) for _ in range(3))
    for t in range(steps):
        before, rz, n = befores[t], gates[t, : 2 * H], gates[t, 2 * H :]
        np.multiply(h, keep[t], out=before)
        product = np.matmul(weights, before)
        products[t] = product[2 * H :]
        rz += product[: 2 * H]
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        h = states[t]
        np.multiply(rz[:H], product[2 * H :], out=h)
        n += h
        np.tanh(n, out=n)
        np.subtract(before, n, out=h)
        h *= rz[H:]
        h += n
    return states, states[-1], (befores, products, gates)


def rows_of(states: np.ndarray, used) -> np.ndarray:
    """One row for each place of a window that holds a token."""
    return states.transpose(0, 2, 1)[used].reshape(-1, states.shape[1])


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place; sums along the long axis are what numpy does fast."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One column for each state."""
    x = weights.T @ states.T
    x += bias[:, None]
    return x


def by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that brings targets of one class together, and the stretch of each class in it."""
    classes = (y // CLASS).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    return order, [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def with_one(states: np.ndarray) -> np.ndarray:
    """States with a further column of ones, for the biases."""
    out = np.ones((len(states), HIDDEN + 1), states.dtype)
    out[:, :HIDDEN] = states
    return out


def word_logits(p: dict, ones: np.ndarray, stretches: list[tuple[int, slice]]) -> np.ndarray:
    """Logits within each target's class, one column for each of the states, which lie by class and end in a one."""
    weights = np.concatenate([p["words"], p["word_bias"][:, None, :]], axis=1)
    x = np.empty((CLASS, len(ones)), np.result_type(ones, weights))
    for c, at in stretches:
        x[:, at] = weights[c].T @ ones[at].T
    return x


def log_softmax_at(x: np.ndarray, rows: np.ndarray | int) -> np.ndarray:
    """Of each column, the entry in the row named. Overwrites ``x``."""
    x -= x.max(axis=0)
    at = x[rows, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return at - np.log(x.sum(axis=0))


def log_probabilities(p: dict, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target."""
    order, stretches = by_class(y)
    s, t, found = states[order], y[order], np.empty(len(y))
    found[order] = log_softmax_at(logits(s, p["classes"], p["class_bias"]), t // CLASS)
    found[order] += log_softmax_at(word_logits(p, with_one(s), stretches), t % CLASS)
    return found


def inputs_of(ids: np.ndarray, keep: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each step's input: the id before it, or START where a document begins."""
    x = np.concatenate([last[None, :], ids[:-1]])
    return np.where(keep == 0, START, x)


def score(vector: np.ndarray, docs: list[np.ndarray], lanes: int) -> np.ndarray:
    """Natural log probability of each document's ids."""
    p, laid, total = unpacked(vector), Lanes(docs, lanes), np.zeros(len(docs))
    h, last = np.zeros((HIDDEN, laid.ids.shape[1]), np.float32), np.zeros(laid.ids.shape[1], np.int16)
    for a, b, n in laid.windows(LONGEST_WINDOW):
        ids, keep = laid.ids[a:b, :n], laid.keep[a:b, :n]
        states, h, _ = run_window(p, inputs_of(ids, keep, last[:n]), keep, h[:, :n])
        used = laid.used(a, b, n)
        total += np.bincount(
            laid.doc[a:b, :n][used].ravel(),
            log_probabilities(p, rows_of(states, used), ids[used].ravel().astype(np.int64)),
            len(docs),
        )
        last = ids[-1]
    return total


def gradient(p: dict, x, keep, h, y, used) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean loss of one window, back through its steps alone, and the last state."""
    H, grad = HIDDEN, np.zeros(LENGTH, np.float32)
    g = unpacked(grad)
    states, last, saved = run_window(p, x, keep, h)
    s, t = rows_of(states, used), y[used].ravel()
    scale = np.float32(1 / max(1, len(t)))
    order, stretches = by_class(t)
    s, t, ds = s[order], t[order], np.empty_like(s)
    dc = softmax(logits(s, p["classes"], p["class_bias"]))
    dc[t // CLASS, np.arange(len(t))] -= 1
    g["classes"][...] = (dc @ s).T
    g["class_bias"][...] = dc.sum(axis=1)
    within = dc.T @ p["classes"].T
    ones = with_one(s)
    dw = softmax(word_logits(p, ones, stretches))
    dw[t % CLASS, np.arange(len(t))] -= 1
    for c, at in stretches:
        both = dw[:, at] @ ones[at]
        g["words"][c] = both[:, :H].T
        g["word_bias"][c] = both[:, H]
        within[at] += dw[:, at].T @ p["words"][c].T
    ds[order] = within
    out = np.zeros((*x.shape, H), np.float32)
    out[used] = ds.reshape(out.shape) if isinstance(used, slice) else ds
    out = np.ascontiguousarray(out.transpose(0, 2, 1))
    before, products, gates = saved
    r, z, n = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H :]
    # Factors of the state's gradient, for all steps at once; the loop keeps what depends on the step after.
    to_candidate, to_update, to_reset = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), products * r * (1 - r)
    dc, dg = np.empty_like(states), np.empty_like(gates)
    back, dh = np.ascontiguousarray(p["state"]), np.zeros_like(last)
    for k in range(len(x) - 1, -1, -1):
        dh += out[k]
        dn, d = dc[k], dg[k]
        np.multiply(dh, to_candidate[k], out=dn)
        np.multiply(dn, to_reset[k], out=d[:H])
        np.multiply(dh, to_update[k], out=d[H : 2 * H])
        np.multiply(dn, r[k], out=d[2 * H :])
        dh *= z[k]
        dh += np.matmul(back, d)
        dh *= keep[k]
    g["state"][...] = np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
    dg[:, 2 * H :] = dc
    flat, ids = dg.transpose(0, 2, 1).reshape(-1, 3 * H), x.ravel()
    order = np.argsort(ids, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    g["inputs"][ids[order][begins]] = np.add.reduceat(flat[order], begins, axis=0)
    grad *= scale
    return grad, last


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(LENGTH, np.float32), np.zeros(LENGTH, np.float32), 0

    def step(self, vector: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > CLIP:
            grad = grad * np.float32(CLIP / norm)
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        vector -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def train(vector: np.ndarray, docs: list[np.ndarray], lanes: int, adam: Adam) -> None:
    """One pass over the documents by truncated backpropagation, a step of ``adam`` for each window; changes ``vector``."""
    laid = Lanes(docs, lanes)
    p = unpacked(vector)
    h, last = np.zeros((HIDDEN, laid.ids.shape[1]), np.float32), np.zeros(laid.ids.shape[1], np.int16)
    for a, b, n in laid.windows():
        ids, keep = laid.ids[a:b, :n], laid.keep[a:b, :n]
        used = laid.used(a, b, n)
        grad, h = gradient(p, inputs_of(ids, keep, last[:n]), keep, h[:, :n], ids.astype(np.int64), used)
        adam.step(vector, grad)
        last = ids[-1]
