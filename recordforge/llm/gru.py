"""A gated recurrent language model in numpy, small enough to travel with a task.

The output softmax is factored: first over classes, then over the words of the
true word's class. The `heads` first classes hold the most frequent words,
`width` each, by rank; further classes hold all other words, whose shares
within their class are not this module's concern.
"""

from __future__ import annotations

import numpy as np

#: Rows of a softmax that are worked on together, so that they stay in the cache.
ROWS = 1024


def new(words: np.ndarray, classes: np.ndarray, heads: int, width: int, hidden: int, seed: int = 5) -> dict:
    """Parameters that start at the frequencies: counts of head words by rank, and of all classes."""
    rng = np.random.default_rng(seed)
    inputs = heads * width + len(classes) - heads + 1
    bias = np.full(heads * width, -1e9, np.float32)
    bias[: len(words)] = np.log(words)
    p = {
        "x": rng.normal(0, 0.1, (inputs, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
        "c": rng.normal(0, 0.1, (hidden, len(classes))), "cb": np.log(classes + 0.5),
        "w": rng.normal(0, 0.1, (heads, hidden, width)), "wb": bias.reshape(heads, width),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(p: dict, x: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (steps, hidden, lanes) after each of the inputs x (steps, lanes), from h (hidden, lanes).

    The last input of the table starts a document: it clears the state.
    """
    n = len(h)
    out, tape = np.empty((len(x), n, x.shape[1]), np.float32), []
    start = x == len(p["x"]) - 1
    some = start.any(1)
    given = np.ascontiguousarray(p["x"][x].transpose(0, 2, 1))
    back = np.ascontiguousarray(p["u"].T)
    for t in range(len(x)):
        if some[t]:
            h = h * ~start[t]
        a = back @ h
        zr = _sigmoid(given[t, : 2 * n] + a[: 2 * n])
        z, r = zr[:n], zr[n:]
        c = r * a[2 * n :]
        c += given[t, 2 * n :]
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        if keep:
            tape.append((h, zr, c, a[2 * n :]))
        out[t] = h = after
    return out, tape


def by_token(hs: np.ndarray) -> np.ndarray:
    """States as rows (steps * lanes, hidden)."""
    return np.ascontiguousarray(hs.transpose(0, 2, 1)).reshape(-1, hs.shape[1])


def _log_softmax_at(z: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of z + bias, at one column a row; z is overwritten.

    The logits of this model are far from where float32 overflows.
    """
    z += bias
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def _softmax(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z += bias
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    return z


def _by_class(classes: np.ndarray, heads: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(heads + 1))
    return [(c, order[cuts[c] : cuts[c + 1]]) for c in range(heads) if cuts[c] < cuts[c + 1]]


def log_probs(p: dict, h: np.ndarray, classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, for head classes, of P(word | class)."""
    out = np.empty(len(h))
    for lo in range(0, len(h), ROWS):
        out[lo : lo + ROWS] = _log_softmax_at(h[lo : lo + ROWS] @ p["c"], p["cb"], classes[lo : lo + ROWS])
    for c, rows in _by_class(classes, len(p["w"])):
        out[rows] += _log_softmax_at(h[rows] @ p["w"][c], p["wb"][c], slots[rows])
    return out


def gradients(p: dict, x: np.ndarray, classes: np.ndarray, slots: np.ndarray, h0: np.ndarray, real: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
    """Mean-loss gradients over one window (backpropagation stops at its start), the last state, the loss.

    `real` (steps, lanes) is false for places that only fill up the window.
    """
    steps, lanes = x.shape
    n = len(h0)
    hs, tape = states(p, x, h0, keep=True)
    h, classes, slots = by_token(hs), classes.ravel(), slots.ravel()
    m = len(h)
    if real is not None:
        real = real.ravel()
        m = max(1, int(real.sum()))
        classes = np.where(real, classes, len(p["w"]))
    g = {"c": np.zeros_like(p["c"]), "cb": np.zeros_like(p["cb"]), "w": {}, "wb": {}}
    dh = np.empty_like(h)
    loss, back = 0.0, np.ascontiguousarray(p["c"].T)
    for lo in range(0, len(h), ROWS):
        part, true = h[lo : lo + ROWS], classes[lo : lo + ROWS]
        q, k = _softmax(part @ p["c"], p["cb"]), np.arange(len(part))
        if real is not None:
            q *= real[lo : lo + ROWS, None]
            k, true = k[real[lo : lo + ROWS]], true[real[lo : lo + ROWS]]
        loss -= np.log(q[k, true]).sum()
        q[k, true] -= 1
        q /= m
        g["c"] += part.T @ q
        g["cb"] += q.sum(0)
        dh[lo : lo + ROWS] = q @ back
    for c, rows in _by_class(classes, len(p["w"])):
        hc, true, k = h[rows], slots[rows], np.arange(len(rows))
        q = _softmax(hc @ p["w"][c], p["wb"][c])
        loss -= np.log(q[k, true]).sum()
        q[k, true] -= 1
        q /= m
        g["w"][c], g["wb"][c] = hc.T @ q, q.sum(0)
        dh[rows] += q @ p["w"][c].T
    dh = np.ascontiguousarray(dh.reshape(steps, lanes, n).transpose(0, 2, 1))
    du, dx = np.zeros((3 * n, n), np.float32), np.empty((steps, 3 * n, lanes), np.float32)
    start = x == len(p["x"]) - 1
    some = start.any(1)
    carry, da = np.zeros_like(h0), np.empty((3 * n, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        before, zr, c, an = tape[t]
        z, r = zr[:n], zr[n:]
        d = dh[t]
        d += carry
        dc = dx[t, 2 * n :]
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= d
        slope = 1 - zr
        dc *= slope[:n]
        slope *= zr
        dz, dr = dx[t, :n], dx[t, n : 2 * n]
        np.subtract(before, c, out=dz)
        dz *= d
        dz *= slope[:n]
        np.multiply(dc, an, out=dr)
        dr *= slope[n:]
        da[: 2 * n] = dx[t, : 2 * n]
        np.multiply(dc, r, out=da[2 * n :])
        du += da @ before.T
        carry = p["u"] @ da
        d *= z
        carry += d
        if some[t]:
            carry *= ~start[t]
    g["u"] = np.ascontiguousarray(du.T)
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    rows = flat[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    g["x"] = (rows[first], np.add.reduceat(by_token(dx)[order], first, axis=0))
    return g, hs[-1], float(loss / m)


def step(p: dict, past: dict, g: dict, rate: float) -> None:
    """One Adagrad step in place; `past` holds the sums of squared gradients."""

    def move(name, at, d):
        past[name][at] += d * d
        p[name][at] -= rate * d / np.sqrt(past[name][at])

    for name in ("c", "cb", "u"):
        move(name, ..., g[name])
    move("x", *g["x"])
    for name in ("w", "wb"):
        for c, d in g[name].items():
            move(name, c, d)


def fresh_past(p: dict) -> dict:
    return {k: np.full_like(v, 1e-8) for k, v in p.items()}


def train(p: dict, past: dict, x: np.ndarray, classes: np.ndarray, slots: np.ndarray, lanes: int, window: int, rate: float) -> None:
    """One pass over a token stream, cut into lanes that advance side by side; every token is learned from once.

    A lane that begins within a document begins there without a state.
    """
    lanes = max(1, min(lanes, len(x) // window))
    length = -(-len(x) // lanes)
    fill = lanes * length - len(x)
    cut = lambda a, end: np.ascontiguousarray(np.pad(a, (0, fill), constant_values=end).reshape(lanes, length).T)
    x, classes, slots, real = cut(x, len(p["x"]) - 1), cut(classes, 0), cut(slots, 0), cut(np.ones(len(x), bool), False)
    h = np.zeros((p["u"].shape[0], lanes), np.float32)
    for t in range(0, length, window):
        part = real[t : t + window]
        g, h, _ = gradients(p, x[t : t + window], classes[t : t + window], slots[t : t + window], h, None if part.all() else part)
        step(p, past, g, rate)


def pack(p: dict) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def unpack(raw: bytes, like: dict, dtype=np.float32) -> dict:
    flat, out, at = np.frombuffer(raw, dtype), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
