"""Three small networks over named arrays: each layer gives its output and how to go back through it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

State = dict[str, np.ndarray]
_MOMENTUM, _EPSILON = 0.1, 1e-5


@dataclass(frozen=True)
class Network:
    """``kind`` is cnn (one convolution), mlp (two hidden layers) or tcn (three dilated blocks); ``channels`` and ``length`` are of an example."""

    kind: str
    channels: int
    length: int = 1
    filters: int = 8
    hidden: tuple[int, int] = (64, 32)
    blocks: tuple[int, int, int] = (32, 48, 64)
    head: int = 32
    dropout: float = 0.2
    scale: float = 0.05

    @property
    def kernel(self) -> int:
        return min(3, self.length) if self.kind == "cnn" else 3

    def shapes(self) -> dict[str, tuple[int, ...]]:
        if self.kind == "cnn":
            return {"conv.weight": (self.filters, self.channels, self.kernel), "conv.bias": (self.filters,), "linear.weight": (self.filters, 1), "linear.bias": (1,)}
        if self.kind == "mlp":
            a, b = self.hidden
            return {"linear1.weight": (self.channels, a), "linear1.bias": (a,), "linear2.weight": (a, b), "linear2.bias": (b,), "linear3.weight": (b, 1), "linear3.bias": (1,)}
        out, inputs = {}, self.channels
        for i, size in enumerate(self.blocks, 1):
            out |= {f"block{i}.conv.weight": (size, inputs, 3), f"block{i}.conv.bias": (size,)}
            out |= {f"block{i}.bn.{n}": (size,) for n in ("weight", "bias", "running_mean", "running_var")} | {f"block{i}.bn.num_batches_tracked": (1,)}
            inputs = size
        return out | {"linear1.weight": (inputs, self.head), "linear1.bias": (self.head,), "linear2.weight": (self.head, 1), "linear2.bias": (1,)}

    def initial(self, seed: int) -> State:
        """Normal weights, zero biases, unit variances."""
        rng = np.random.default_rng(seed)
        ones = ("bn.weight", "running_var")
        return {k: np.ones(s, np.float32) if k.endswith(ones) else rng.normal(0.0, self.scale, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for k, s in self.shapes().items()}

    def forward(self, state: State, x: np.ndarray, rng: np.random.Generator | None = None):
        """Logits of examples (B, channels, length), the way back from their gradient to the parameters', and new batch statistics.

        With ``rng`` dropout and batch statistics are those of training.
        """
        steps, fresh = [], {}

        def run(layer, x, *args):
            out, back = layer(x, *args)
            steps.append(back)
            return out

        if self.kind == "mlp":
            x = x.reshape(len(x), -1)
            for i in (1, 2):
                x = run(_relu, run(_linear, x, state, f"linear{i}"))
                x = run(_dropout, x, self.dropout if rng else 0.0, rng)
            x = run(_linear, x, state, "linear3")
        elif self.kind == "cnn":
            x = run(_mean, run(_relu, run(_convolution, x, state, "conv", 1, 0)))
            x = run(_linear, x, state, "linear")
        else:
            for i, dilation in enumerate((1, 2, 4), 1):
                x = run(_convolution, x, state, f"block{i}.conv", dilation, dilation)
                x = run(_batch_norm, x, state, f"block{i}.bn", rng is not None, fresh)
                x = run(_dropout, run(_relu, x), self.dropout if rng else 0.0, rng)
            x = run(_relu, run(_linear, run(_mean, x), state, "linear1"))
            x = run(_linear, x, state, "linear2")

        def back(gradient: np.ndarray) -> State:
            gradients: State = {}
            gradient = gradient.reshape(-1, 1)
            for step in reversed(steps):
                gradient, found = step(gradient)
                gradients |= found
            return gradients

        return x.reshape(-1), back, fresh


def _linear(x, state, name):
    w, b = state[f"{name}.weight"], state[f"{name}.bias"]
    return x @ w + b, lambda g: (g @ w.T, {f"{name}.weight": x.T @ g, f"{name}.bias": g.sum(0)})


def _relu(x):
    return np.maximum(x, 0), lambda g: (g * (x > 0), {})


def _dropout(x, share, rng):
    if not share:
        return x, lambda g: (g, {})
    keep = (rng.random(x.shape) >= share) / np.float32(1 - share)
    return x * keep, lambda g: (g * keep, {})


def _mean(x):
    n = x.shape[2]
    return x.mean(2), lambda g: (np.repeat(g[:, :, None] / n, n, axis=2), {})


def _convolution(x, state, name, dilation, pad):
    """Convolution as a sum over kernel places, each a matrix product of shifted inputs."""
    w, b = state[f"{name}.weight"], state[f"{name}.bias"]
    padded = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    size = padded.shape[2] - dilation * (w.shape[2] - 1)
    shifts = [slice(k * dilation, k * dilation + size) for k in range(w.shape[2])]
    out = sum(np.einsum("bcl,oc->bol", padded[:, :, s], w[:, :, k], optimize=True) for k, s in enumerate(shifts)) + b[None, :, None]

    def back(g):
        inward, weight = np.zeros_like(padded), np.zeros_like(w)
        for k, s in enumerate(shifts):
            inward[:, :, s] += np.einsum("bol,oc->bcl", g, w[:, :, k], optimize=True)
            weight[:, :, k] = np.einsum("bol,bcl->oc", g, padded[:, :, s], optimize=True)
        return inward[:, :, pad : padded.shape[2] - pad], {f"{name}.weight": weight, f"{name}.bias": g.sum((0, 2))}

    return out, back


def _batch_norm(x, state, name, training, fresh):
    if training:
        mean, var = x.mean((0, 2)), x.var((0, 2))
        for key, value in (("running_mean", mean), ("running_var", var)):
            fresh[f"{name}.{key}"] = (1 - _MOMENTUM) * state[f"{name}.{key}"] + _MOMENTUM * value
        fresh[f"{name}.num_batches_tracked"] = state[f"{name}.num_batches_tracked"] + 1
    else:
        mean, var = state[f"{name}.running_mean"], state[f"{name}.running_var"]
    scale = 1.0 / np.sqrt(var + _EPSILON)
    normal = (x - mean[None, :, None]) * scale[None, :, None]
    w = state[f"{name}.weight"]

    def back(g):
        found = {f"{name}.weight": (g * normal).sum((0, 2)), f"{name}.bias": g.sum((0, 2))}
        g = g * w[None, :, None]
        if training:
            g = g - g.mean((0, 2))[None, :, None] - normal * (g * normal).mean((0, 2))[None, :, None]
        return g * scale[None, :, None], found

    return normal * w[None, :, None] + state[f"{name}.bias"][None, :, None], back


def probabilities(logits: np.ndarray) -> np.ndarray:
    return np.clip(1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30))), 1e-6, 1 - 1e-6)


def weighted_loss(logits: np.ndarray, labels: np.ndarray, positive_weight: float) -> tuple[float, np.ndarray]:
    """Mean binary cross-entropy of logits and its gradient; positives weigh ``positive_weight``."""
    y = labels.astype(np.float64)
    soft = np.maximum(logits, 0) + np.log1p(np.exp(-np.abs(logits)))
    loss = positive_weight * y * (soft - logits) + (1 - y) * soft
    p = 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))
    return float(loss.mean()), ((1 - y) * p - positive_weight * y * (1 - p)) / len(y)
