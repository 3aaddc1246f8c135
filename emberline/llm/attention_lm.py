"""A small causal self-attention language model in numpy: tables, training step, windowed scoring.

Subword ids fall into CLASSES classes, SIDE groups of SIDE: frequent ids have a class of their own, rare ones share
classes of like frequency (ids that begin a word apart from others). The model gives the next class in two
levels, group then class in the group, and the id in its class by its corpus frequency:

    logits = direct[last class] + W . attention output,   attention output = softmax(q k' / sqrt(d)) v

`direct` holds the log frequencies with which classes follow each other in the texts of the corpus; queries, keys, values
and W are trained. All probabilities are normalised, so a text's probability is that of a proper model.

A text is cut into windows of CONTEXT + STEP places that overlap by CONTEXT: each token is scored once, with
CONTEXT to CONTEXT + STEP - 1 tokens of the text before it (fewer where it begins). Windows of many texts are scored
in one batch under one causal mask.
"""

from __future__ import annotations

import math

import numpy as np

SIDE = 32
CLASSES = SIDE * SIDE
#: Classes of ids that have one of their own; the rest, without START, are shared.
OWN = 960
START = CLASSES - 1
WIDTH = 16
CONTEXT, STEP = 8, 24
LENGTH = CONTEXT + STEP
#: Taken off each follow-up count.
DISCOUNT = 0.75
BATCH = 256
#: Windows in a training step, and steps after which the rate has fallen to 1/sqrt(2).
TRAIN_BATCH, FALL = 256, 100

Params = dict[str, np.ndarray]


def class_tables(counts: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and log probability of the id in its class. `counts`: corpus counts by id."""
    weight = counts + 0.5
    order = np.argsort(-weight, kind="stable")
    order = order[order != end_id]
    of = np.full(len(counts), -1, dtype=np.int64)
    of[end_id] = 0
    own = order[: OWN - 1]
    of[own] = np.arange(1, len(own) + 1)
    nxt, bins = OWN, (CLASSES - 1 - OWN) // 2
    for kind in (True, False):
        rest = order[OWN - 1 :]
        rest = rest[begins[rest] == kind]
        if len(rest):
            share = np.cumsum(weight[rest]) - weight[rest] / 2
            of[rest] = nxt + np.minimum((share / weight[rest].sum() * bins).astype(np.int64), bins - 1)
        nxt += bins
    mass = np.bincount(of, weight, CLASSES)
    return of, np.log(weight / mass[of]).astype(np.float32)


def direct_tables(pairs: np.ndarray) -> Params:
    """Log frequencies of the next group and of the class in it, after each class, by absolute discounting.

    `pairs[a, b]`: how often b follows a in texts; START stands before one. What is discounted goes half to classes by their frequency, half by
    the number of classes that they follow.
    """
    follows = pairs > 0
    plain, wide = pairs.sum(axis=0) + 0.1, follows.sum(axis=0) + 0.5
    other = plain / plain.sum() / 2 + wide / wide.sum() / 2
    cut = np.maximum(pairs - DISCOUNT, 0)
    left = DISCOUNT * follows.sum(axis=1, keepdims=True) + 1
    p = (cut + left * other) / (cut.sum(axis=1, keepdims=True) + left)
    p = p.reshape(CLASSES, SIDE, SIDE)
    group = p.sum(axis=2)
    return {"group": np.log(group).astype(np.float32), "inner": np.log(p / group[:, :, None]).astype(np.float32)}


def keep_memory() -> None:
    """Have the C library keep freed arrays of up to 31 MB for the next ones; it maps and clears pages anew for each until one of that size was freed."""
    np.empty(31 << 20, dtype=np.uint8)


def new_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    return {
        "q": small(CLASSES, WIDTH), "k": small(CLASSES, WIDTH), "v": small(CLASSES, WIDTH), "pq": small(LENGTH, WIDTH), "pk": small(LENGTH, WIDTH),
        "wg": small(WIDTH, SIDE), "wi": small(SIDE, WIDTH, SIDE), "bg": np.zeros(SIDE, np.float32),
    }


def windows(classes: np.ndarray, sizes: np.ndarray, every: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, int]:
    """Inputs (n, LENGTH) and targets (n, STEP, -1 where there is none) for texts laid end to end, and how many windows they have in all.

    Sizes are positive. The input at a place is the class before its target; START stands before a text. `every`: the windows wanted.
    """
    per = -(-sizes // STEP)
    count = int(per.sum())
    first = (np.arange(count) - np.repeat(np.cumsum(per) - per, per))[every] * STEP
    text_at, size = (np.repeat(x, per)[every] for x in (np.cumsum(sizes) - sizes, sizes))
    # Classes with STARTs before and after, so that places outside a text need no care until they are overwritten.
    padded = np.concatenate([np.full(CONTEXT + 1, START, dtype=classes.dtype), classes, np.full(STEP, START, dtype=classes.dtype)])
    span = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + 1)[text_at + first]
    inputs, targets = span[:, :-1].copy(), span[:, CONTEXT + 1 :].copy()
    begins = np.flatnonzero(first == 0)
    inputs[begins, : CONTEXT + 1] = START
    cut = np.flatnonzero(size - first < STEP)
    beyond = np.arange(STEP)[None, :] >= (size - first)[cut, None]
    inputs[cut, CONTEXT:] = np.where(beyond, START, inputs[cut, CONTEXT:])
    targets[cut] = np.where(beyond, -1, targets[cut])
    return inputs, targets, count


def _bounded(p: Params) -> bool:
    """Whether attention scores and what is added to log frequencies are under 60 whatever the input, so that exp can't overflow."""
    size = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1).max()))
    scores = (size(p["q"]) + size(p["pq"])) * (size(p["k"]) + size(p["pk"])) / math.sqrt(WIDTH)
    added = size(p["v"]) * max(size(p["wg"].T) + float(np.abs(p["bg"]).max()), size(p["wi"].transpose(0, 2, 1).reshape(-1, WIDTH)))
    return scores < 60 and added < 60


#: Columns of a place's attention output: values and a one, so that the groups' bias is one more row of weights.
OUT = WIDTH + 1


def _tables(p: Params) -> Params:
    """Queries scaled; values with a one for the sums; for each group the weights (OUT, 2 * SIDE) of the logits of all groups and of its classes."""
    scale = np.float32(1 / math.sqrt(WIDTH))
    weights = np.zeros((SIDE, OUT, 2 * SIDE), dtype=p["wi"].dtype)
    weights[:, :WIDTH, :SIDE], weights[:, WIDTH, :SIDE], weights[:, :WIDTH, SIDE:] = p["wg"], p["bg"], p["wi"]
    ones = np.ones((CLASSES, 1), dtype=p["v"].dtype)
    return {"q": p["q"] * scale, "pq": p["pq"][CONTEXT:] * scale, "k": p["k"], "pk": p["pk"], "v": np.concatenate([p["v"], ones], axis=1), "out": weights}


def direct_rows(direct: Params) -> np.ndarray:
    """Rows of SIDE log frequencies: of the groups after each class, then of the classes in each group after each class."""
    return np.concatenate([direct["group"], direct["inner"].reshape(-1, SIDE)])


#: 1 where a place may look: at itself and at what is before it. The first CONTEXT places ask nothing.
SEEN = (np.arange(LENGTH)[None, :] <= np.arange(CONTEXT, LENGTH)[:, None]).astype(np.float32)


def _attend(t: Params, c: np.ndarray, safe: bool) -> tuple[np.ndarray, ...]:
    """Scaled queries, keys, values (with a one), weights before they are divided by their sums, outputs (with a one), sums."""
    q = t["q"].take(c[:, CONTEXT:], axis=0)
    q += t["pq"]
    k = t["k"].take(c, axis=0)
    k += t["pk"]
    v = t["v"].take(c, axis=0)
    a = q @ k.transpose(0, 2, 1)
    if not safe:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= SEEN
    o = a @ v
    total = o[:, :, WIDTH:].copy()
    o /= total
    return q, k, v, a, o, total


#: Sums over a last axis of 32 are products with this.
_ONES = np.ones(SIDE, dtype=np.float32)


def _sorted_outputs(t: Params, rows: np.ndarray, o: np.ndarray, last: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in order of their target's group: order, ends of the groups, where the logits of the target's group and class lie, outputs, logits (groups, then classes in the group)."""
    group = (goal // SIDE).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    group, last, o = group.take(order), last.take(order), o.take(order, axis=0)
    ends = np.searchsorted(group, np.arange(SIDE + 1, dtype=np.uint8)).tolist()
    group = group.astype(np.intp)
    at = np.empty((2, len(order)), dtype=np.intp)
    at[:] = np.arange(0, len(order) * 2 * SIDE, 2 * SIDE)
    at[0] += group
    at[1] += (goal % SIDE).take(order) + SIDE
    picked = np.empty((len(order), 2), dtype=np.intp)
    picked[:, 0] = last
    np.add(last * SIDE, group + CLASSES, out=picked[:, 1])
    z = np.empty((len(order), 2 * SIDE), dtype=o.dtype)
    for g in range(SIDE):
        if ends[g + 1] > ends[g]:
            np.matmul(o[ends[g] : ends[g + 1]], t["out"][g], out=z[ends[g] : ends[g + 1]])
    z += rows.take(picked.ravel(), axis=0).reshape(z.shape)
    return order, ends, at, o, z


def _exp_sums(z: np.ndarray, safe: bool) -> np.ndarray:
    """Overwrites logits (n, 2 * SIDE) by their exponentials; sums of the halves (n, 2)."""
    if not safe:
        np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return (z.reshape(-1, SIDE) @ _ONES).reshape(-1, 2)


def log_probs(p: Params, direct: Params, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target class, 0 where there is none."""
    out = np.zeros(targets.shape, dtype=np.float32)
    t, rows, safe = _tables(p), direct_rows(direct), _bounded(p)
    for i in range(0, len(inputs), BATCH):
        c, y = inputs[i : i + BATCH].astype(np.intp), targets[i : i + BATCH].ravel().astype(np.intp)
        o = _attend(t, c, safe)[4].reshape(-1, OUT)
        # Places without a target are worked out as if class 0 were theirs, and left out at the end.
        order, _, at, _, z = _sorted_outputs(t, rows, o, c[:, CONTEXT:].ravel(), np.maximum(y, 0))
        if not safe:
            np.minimum(z, 60, out=z)
        chosen = z.ravel().take(at)
        logs = np.log(_exp_sums(z, True))
        found = chosen[0] + chosen[1] - logs[:, 0] - logs[:, 1]
        flat = np.empty_like(found)
        flat[order] = found
        flat[y < 0] = 0
        out[i : i + BATCH] = flat.reshape(-1, STEP)
    return out


def _scattered(at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of the rows of d (an even number of float32) by class."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    found = at.take(order)
    cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    out = np.zeros((CLASSES, d.shape[1]), dtype=np.float32)
    # A sum of complex numbers is two sums: reduceat goes through half as many columns.
    out[found.take(cuts)] = np.add.reduceat(d.take(order, axis=0).view(np.complex64), cuts, axis=0).view(np.float32)
    return out


def gradients(p: Params, rows: np.ndarray | Params, c: np.ndarray, y: np.ndarray, safe: bool = False) -> Params:
    """Gradient of the mean negative log probability of the targets (y >= 0). `rows`: direct_rows, or the tables themselves."""
    c, y = c.astype(np.intp), y.ravel().astype(np.intp)
    rows = direct_rows(rows) if isinstance(rows, dict) else rows
    t = _tables(p)
    q, k, v, a, o, total = _attend(t, c, safe)
    # Places without a target weigh nothing.
    weight = (y >= 0).astype(np.float32)
    weight /= max(1.0, float(weight.sum()))
    order, ends, at, so, z = _sorted_outputs(t, rows, o.reshape(-1, OUT), c[:, CONTEXT:].ravel(), np.maximum(y, 0))
    weight = weight.take(order)
    halves = z.reshape(-1, SIDE)
    halves *= (weight[:, None] / _exp_sums(z, safe)).reshape(-1, 1)
    z.ravel()[at] -= weight
    by_group, d_sorted = np.zeros((SIDE, 2 * SIDE, OUT), dtype=np.float32), np.empty_like(so)
    for g in range(SIDE):
        if ends[g + 1] > ends[g]:
            own = z[ends[g] : ends[g + 1]]
            np.matmul(own.T, so[ends[g] : ends[g + 1]], out=by_group[g])
            np.matmul(own, t["out"][g].T, out=d_sorted[ends[g] : ends[g + 1]])
    to_groups = by_group[:, :SIDE].sum(axis=0).T
    grads: Params = {"wg": to_groups[:WIDTH], "bg": to_groups[WIDTH], "wi": by_group[:, SIDE:, :WIDTH].transpose(0, 2, 1)}
    # Through the softmax: each weight times (what its value gets less what the place gets in all, which meets the values' one).
    d_sorted[:, WIDTH] = 0
    d_sorted[:, WIDTH] = (d_sorted * so) @ np.full(OUT, -1, dtype=np.float32)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    part = d_sorted.take(back, axis=0).reshape(o.shape)
    part /= total
    d_s = part @ v.transpose(0, 2, 1)
    d_s *= a
    d_all = np.empty((*c.shape, 3 * WIDTH), dtype=np.float32)
    d_all[:, :CONTEXT, :WIDTH] = 0
    np.matmul(d_s, k, out=d_all[:, CONTEXT:, :WIDTH])
    np.matmul(d_s.transpose(0, 2, 1), q, out=d_all[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), part[:, :, :WIDTH], out=d_all[:, :, 2 * WIDTH :])
    by_place = (np.ones(len(c), dtype=np.float32) @ d_all.reshape(len(c), -1)).reshape(LENGTH, -1)
    by_class = _scattered(c.ravel(), d_all.reshape(-1, 3 * WIDTH))
    scale = np.float32(1 / math.sqrt(WIDTH))
    grads["pq"], grads["pk"] = by_place[:, :WIDTH] * scale, by_place[:, WIDTH : 2 * WIDTH]
    grads["q"], grads["k"], grads["v"] = by_class[:, :WIDTH] * scale, by_class[:, WIDTH : 2 * WIDTH], by_class[:, 2 * WIDTH :]
    return grads


class Trainer:
    """Adam steps over a stream of windows with a falling rate; every window is used once."""

    def __init__(self, p: Params, direct: Params, seed: int | list[int] = 1, rate: float = 0.04) -> None:
        # All weights lie in one array, and p has views of it: a step is a few operations over all of them.
        self._flat = np.concatenate([v.ravel() for v in p.values()])
        self._gradient, self._scratch, self._mean, self._square = (np.zeros_like(self._flat) for _ in range(4))
        ends = np.cumsum([v.size for v in p.values()])
        self._at = {k: slice(end - v.size, end) for (k, v), end in zip(p.items(), ends, strict=True)}
        self.p = {k: self._flat[self._at[k]].reshape(v.shape) for k, v in p.items()}
        self._rows, self.rate, self.t = direct_rows(direct), rate, 0
        self._rng = np.random.default_rng(seed)

    def see(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        order = self._rng.permutation(len(inputs))
        for i in range(0, len(order), TRAIN_BATCH):
            self._step(inputs[order[i : i + TRAIN_BATCH]], targets[order[i : i + TRAIN_BATCH]])

    def _step(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        self.t += 1
        # A batch that is not full weighs less.
        rate = self.rate / math.sqrt(1 + self.t / FALL) * len(inputs) / TRAIN_BATCH
        rate *= math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        if self.t % 32 == 1:  # weights move little in 32 steps: 60 is far under what exp takes
            self._safe = _bounded(self.p)
        g, scratch = self._gradient, self._scratch
        for name, found in gradients(self.p, self._rows, inputs, targets, self._safe).items():
            g[self._at[name]] = found.ravel()
        self._mean *= np.float32(0.9)
        self._mean += np.multiply(g, np.float32(0.1), out=scratch)
        self._square *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        self._square += g
        np.sqrt(self._square, out=scratch)
        scratch += np.float32(1e-8)
        np.divide(self._mean, scratch, out=scratch)
        scratch *= np.float32(rate)
        self._flat -= scratch
