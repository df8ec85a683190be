"""NumPy arithmetic of an LSTM encoder-decoder for one Arrow batch.

A helper for the tasks in ``operators.lstm``: it knows nothing about data layout
or distribution. Gate order is input, forget, cell, output, with two bias
vectors per layer. All weights of a model are one flat vector.
"""

from __future__ import annotations

import numpy as np

from tidemark.config import ModelSpec


def layout(spec: ModelSpec) -> list[tuple[str, tuple]]:
    """Names and shapes of the weights in storage order."""
    out = []
    for part in ("encoder", "decoder"):
        for layer in range(spec.layers):
            width = spec.input_dim if layer == 0 else spec.hidden
            out += [
                (f"{part}.{layer}.input", (4 * spec.hidden, width)),
                (f"{part}.{layer}.recurrent", (4 * spec.hidden, spec.hidden)),
                (f"{part}.{layer}.input_bias", (4 * spec.hidden,)),
                (f"{part}.{layer}.recurrent_bias", (4 * spec.hidden,)),
            ]
    return out + [("output.weight", (spec.input_dim, spec.hidden)), ("output.bias", (spec.input_dim,))]


def unflatten(theta: np.ndarray, spec: ModelSpec) -> dict[str, np.ndarray]:
    """Named views into the flat vector, or into one vector per window, whose weights then have a leading axis."""
    out, at = {}, 0
    for name, shape in layout(spec):
        n = int(np.prod(shape))
        out[name] = theta[..., at : at + n].reshape(*theta.shape[:-1], *shape)
        at += n
    if at != theta.shape[-1]:
        raise ValueError(f"expected {at} weights, got {theta.shape[-1]}")
    return out


def initial(spec: ModelSpec, seed: int) -> np.ndarray:
    bound = 1.0 / np.sqrt(spec.hidden)
    return np.random.default_rng(seed).uniform(-bound, bound, spec.parameter_count)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _times(x, weight):
    """``x`` (batch, width) or (batch, time, width) times a matrix, or times the matrix of each window."""
    if weight.ndim == 2:
        return x @ weight.T
    turned = weight.transpose(0, 2, 1)
    return x @ turned if x.ndim == 3 else (x[:, None, :] @ turned)[:, 0]


def _plus(x, bias):
    return x + (bias if bias.ndim == 1 else bias[:, None, :])


def _layer(w, name, x, h, c, tape=None):
    """One layer over time: ``x`` (batch, time, width) to all hidden states."""
    wx, wh = w[f"{name}.input"], w[f"{name}.recurrent"]
    drive = _plus(_times(x, wx), w[f"{name}.input_bias"] + w[f"{name}.recurrent_bias"])
    n, out = h.shape[1], np.empty((x.shape[0], x.shape[1], h.shape[1]))
    for t in range(x.shape[1]):
        a = drive[:, t] + _times(h, wh)
        i, f, o = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), _sigmoid(a[:, 3 * n :])
        g = np.tanh(a[:, 2 * n : 3 * n])
        before = (h, c)
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
        if tape is not None:
            tape.append((i, f, g, o, before, c))
    return out, h, c


def _stack(w, part, spec, x, state, tapes=None, drop=None):
    """All layers; ``state`` is a list of (h, c). ``drop`` gives masks between layers."""
    final = []
    for layer in range(spec.layers):
        tape = [] if tapes is not None else None
        mask = None
        if layer and drop is not None:
            mask = (drop.random(x.shape) >= spec.dropout) / (1.0 - spec.dropout)
            x = x * mask
        y, h, c = _layer(w, f"{part}.{layer}", x, *state[layer], tape)
        if tapes is not None:
            tapes.append((x, tape, mask))
        final.append((h, c))
        x = y
    return x, final


def _zero_state(spec, n):
    return [(np.zeros((n, spec.hidden)), np.zeros((n, spec.hidden))) for _ in range(spec.layers)]


def encode(theta, spec, x):
    """Final (h, c) of every layer."""
    return _stack(unflatten(theta, spec), "encoder", spec, x, _zero_state(spec, len(x)))[1]


def reconstruct(theta, spec, x):
    """Teacher-forced: the decoder reads the reversed input, its output is reversed back."""
    w = unflatten(theta, spec)
    top, _ = _stack(w, "decoder", spec, x[:, ::-1], encode(theta, spec, x))
    return _plus(_times(top, w["output.weight"]), w["output.bias"])[:, ::-1]


def generate(theta, spec, x):
    """Free-running: starts from the last input step and feeds its own output."""
    w = unflatten(theta, spec)
    state, step, out = encode(theta, spec, x), x[:, -1:], []
    for _ in range(x.shape[1]):
        top, state = _stack(w, "decoder", spec, step, state)
        step = _plus(_times(top, w["output.weight"]), w["output.bias"])
        out.append(step)
    return np.concatenate(out, axis=1)[:, ::-1]


def _layer_back(w, grad, name, x, tape, dy, dh, dc):
    """Back through one layer; returns gradients of its input and of its first state."""
    wx, wh = w[f"{name}.input"], w[f"{name}.recurrent"]
    da_all = np.empty((x.shape[0], x.shape[1], wx.shape[0]))
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, g, o, (h0, c0), c1 = tape[t]
        tc = np.tanh(c1)
        dh = dh + dy[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
        da_all[:, t] = da
        grad[f"{name}.recurrent"] += da.T @ h0
        dh, dc = da @ wh, dc * f
    flat = da_all.reshape(-1, da_all.shape[2])
    grad[f"{name}.input"] += flat.T @ x.reshape(-1, x.shape[2])
    bias = flat.sum(axis=0)
    grad[f"{name}.input_bias"] += bias
    grad[f"{name}.recurrent_bias"] += bias
    return da_all @ wx, dh, dc


def _stack_back(w, grad, part, spec, tapes, dy, dfinal):
    dstart = [None] * spec.layers
    for layer in range(spec.layers - 1, -1, -1):
        x, tape, mask = tapes[layer]
        dy, dh, dc = _layer_back(w, grad, f"{part}.{layer}", x, tape, dy, *dfinal[layer])
        if mask is not None:
            dy = dy * mask
        dstart[layer] = (dh, dc)
    return dstart


def squared_error_grad(theta, spec, x, rng=None):
    """Sum of squared reconstruction errors and its gradient (dropout only with ``rng`` and several layers)."""
    w = unflatten(theta, spec)
    gflat = np.zeros_like(theta)
    grad = unflatten(gflat, spec)
    drop = rng if spec.layers > 1 and spec.dropout > 0 else None
    enc, dec = [], []
    _, state = _stack(w, "encoder", spec, x, _zero_state(spec, len(x)), enc, drop)
    flipped = x[:, ::-1]
    top, _ = _stack(w, "decoder", spec, flipped, state, dec, drop)
    diff = top @ w["output.weight"].T + w["output.bias"] - flipped
    dy = 2.0 * diff
    grad["output.weight"] += dy.reshape(-1, spec.input_dim).T @ top.reshape(-1, spec.hidden)
    grad["output.bias"] += dy.sum(axis=(0, 1))
    dtop = dy @ w["output.weight"]
    dstate = _stack_back(w, grad, "decoder", spec, dec, dtop, _zero_state(spec, len(x)))
    _stack_back(w, grad, "encoder", spec, enc, np.zeros_like(top), dstate)
    return float((diff * diff).sum()), gflat


class Adam:
    """Adam with gradient-norm clipping and optional weight decay."""

    def __init__(self, rate: float, clip: float = 1.0, decay: float = 0.0):
        self.rate, self.clip, self.decay, self.t = rate, clip, decay, 0
        self.m = self.v = 0.0

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.clip > 0:
            grad = grad * min(1.0, self.clip / (np.linalg.norm(grad) + 1e-6))
        if self.decay:
            grad = grad + self.decay * theta
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return theta - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Progress:
    """Early stopping and best-weights rule."""

    def __init__(self, patience: int, min_delta: float):
        self.patience, self.min_delta = patience, min_delta
        self.reference = self.best_loss = float("inf")
        self.stale, self.best_theta, self.best_epoch = 0, None, 0
        self.train, self.val = [], []

    def update(self, theta, train_loss: float, val_loss: float) -> bool:
        """Record an epoch; true when training should stop."""
        self.train.append(float(train_loss))
        self.val.append(float(val_loss))
        if val_loss < self.best_loss:
            self.best_loss, self.best_theta, self.best_epoch = val_loss, theta.copy(), len(self.val)
        if val_loss < self.reference - self.min_delta:
            self.reference, self.stale = val_loss, 0
        else:
            self.stale += 1
        return self.stale >= self.patience
