"""A small convolutional autoencoder in NumPy, behind the contract of Reconstruction.

The net is strided convolutions, a linear bottleneck, and the same number of
transposed convolutions. A transposed convolution is the adjoint of the
convolution that it mirrors, taken at that one's input length, so every window
comes back at its own length. It is trained on the driver by Adam on a bounded,
hashed sample of training windows (settings.max_windows); scoring runs in Arrow
batches on the executors. Arrays are (windows, time, channels)."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconstructionSettings
from .reconstruct import Reconstruction, validation_split

STRIDE = 2


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = np.tanh(0.7978845608 * (x + 0.044715 * x**3))
    slope = 0.5 * (1 + inner) + 0.5 * x * (1 - inner**2) * 0.7978845608 * (1 + 3 * 0.044715 * x**2)
    return 0.5 * x * (1 + inner), slope


#: Value and derivative.
ACTIVATIONS = {
    "relu": lambda x: (np.maximum(x, 0), (x > 0).astype(x.dtype)),
    "leaky_relu": lambda x: (np.where(x > 0, x, 0.01 * x), np.where(x > 0, 1, 0.01).astype(x.dtype)),
    "gelu": _gelu,
}


def conv_length(length: int, kernel: int) -> int:
    return (length + 2 * (kernel // 2) - kernel) // STRIDE + 1


def _taps(x: np.ndarray, kernel: int, steps: int) -> list[np.ndarray]:
    """For each tap, the input places that it meets at the `steps` output places."""
    half = kernel // 2
    short = max(0, STRIDE * (steps - 1) + kernel - x.shape[1] - half)
    padded = np.pad(x, ((0, 0), (half, short), (0, 0)))
    return [padded[:, k : k + STRIDE * (steps - 1) + 1 : STRIDE] for k in range(kernel)]


def gather(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The strided convolution with w (kernel, in, out)."""
    return sum(part @ tap for part, tap in zip(_taps(x, len(w), conv_length(x.shape[1], len(w))), w, strict=True))


def spread(y: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """The adjoint of gather() for inputs of the given length."""
    steps, half = y.shape[1], len(w) // 2
    out = np.zeros((len(y), length + 2 * half + STRIDE, w.shape[1]), dtype=y.dtype)
    for k, tap in enumerate(w):
        out[:, k : k + STRIDE * (steps - 1) + 1 : STRIDE] += y @ tap.T
    return out[:, half : half + length]


def tap_products(x: np.ndarray, y: np.ndarray, kernel: int) -> np.ndarray:
    """The gradient of sum(gather(x, w) * y) with respect to w."""
    return np.stack([np.tensordot(part, y, ((0, 1), (0, 1))) for part in _taps(x, kernel, y.shape[1])])


class ConvNet:
    def __init__(self, channels: int, length: int, s: ReconstructionSettings):
        if s.kernel % 2 == 0:
            raise ValueError(f"the kernel must be odd, not {s.kernel}")
        if not s.widths:
            raise ValueError("no layer widths")
        if s.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {s.activation!r}")
        self.s, self.sizes = s, [channels, *s.widths]
        self.lengths = [length]
        for _ in s.widths:
            self.lengths.append(conv_length(self.lengths[-1], s.kernel))
        if min(self.lengths) < 1:
            raise ValueError(f"{len(s.widths)} layers narrow windows of {length} rows to nothing")
        rng = np.random.default_rng(s.seed)
        draw = lambda fan, *shape: rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(np.sqrt(fan))
        flat, n = self.lengths[-1] * self.sizes[-1], len(s.widths)
        self.p: dict[str, np.ndarray] = {}
        for i in range(n):
            a, b = self.sizes[i], self.sizes[i + 1]
            self.p |= {f"down{i}": draw(a * s.kernel, s.kernel, a, b), f"down{i}_bias": draw(a * s.kernel, b)}
            self.p |= {f"up{i}": draw(b * s.kernel, s.kernel, a, b), f"up{i}_bias": draw(b * s.kernel, a)}
        self.p |= {"in": draw(flat, flat, s.bottleneck), "in_bias": draw(flat, s.bottleneck)}
        self.p |= {"out": draw(s.bottleneck, s.bottleneck, flat), "out_bias": draw(s.bottleneck, flat)}

    def _active(self, x: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
        value, slope = ACTIVATIONS[self.s.activation](x)
        if rng is not None and self.s.dropout > 0:
            kept = (rng.random(x.shape) >= self.s.dropout).astype(x.dtype) / np.float32(1 - self.s.dropout)
            return value * kept, slope * kept
        return value, slope

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None, trace: list | None = None) -> np.ndarray:
        """The reconstruction. rng: drop units (training). trace: gets what backward() needs."""
        p, n, kept = self.p, len(self.s.widths), []
        for i in range(n):
            before = x
            x, slope = self._active(gather(x, p[f"down{i}"]) + p[f"down{i}_bias"], rng)
            kept.append((before, slope))
        flat = x.reshape(len(x), -1)
        code = flat @ p["in"] + p["in_bias"]
        x = (code @ p["out"] + p["out_bias"]).reshape(x.shape)
        kept.append((flat, code))
        for i in reversed(range(n)):
            before = x
            x = spread(x, p[f"up{i}"], self.lengths[i]) + p[f"up{i}_bias"]
            slope = None
            if i:
                x, slope = self._active(x, rng)
            kept.append((before, slope))
        if trace is not None:
            trace.extend(kept)
        return x

    def backward(self, trace: list, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, from that of the reconstruction."""
        p, n, g = self.p, len(self.s.widths), {}
        for i in range(n):  # the last step of forward() is up0
            before, slope = trace.pop()
            d = d if slope is None else d * slope
            g[f"up{i}"], g[f"up{i}_bias"] = tap_products(d, before, self.s.kernel), d.sum(axis=(0, 1))
            d = gather(d, p[f"up{i}"])
        flat, code = trace.pop()
        shape, d = d.shape, d.reshape(len(d), -1)
        g["out"], g["out_bias"] = code.T @ d, d.sum(axis=0)
        d = d @ p["out"].T
        g["in"], g["in_bias"] = flat.T @ d, d.sum(axis=0)
        d = (d @ p["in"].T).reshape(shape)
        for i in reversed(range(n)):
            before, slope = trace.pop()
            d = d * slope
            g[f"down{i}"], g[f"down{i}_bias"] = tap_products(before, d, self.s.kernel), d.sum(axis=(0, 1))
            d = spread(d, p[f"down{i}"], before.shape[1])
        return g


class ConvAutoencoder(Reconstruction):
    """fit() adds epochs_run, train_loss, validation_loss (None without validation windows) and elapsed_s."""

    def fit(self, train: DataFrame, by: Sequence[str] = ("asset_id",)) -> ConvAutoencoder:
        """train: rows with by, us and w. The trailing part of each series validates; the rest trains in time order."""
        s = self.settings
        rows = validation_split(train.select(*by, "us", "w"), s.validation, by)
        total = rows.count()
        if not total:
            raise ValueError("no training windows")
        if total > s.max_windows:
            rows = rows.where(F.pmod(F.xxhash64(*by, "us"), F.lit(1 << 30)) < int((1 << 30) * (s.max_windows / total)))
        got = rows.orderBy(*by, "us").select("validation", "w").toPandas()
        x, late = self._windows(got["w"]), got["validation"].to_numpy()
        self._train(x[~late], x[late])
        return self

    def _windows(self, w: pd.Series) -> np.ndarray:
        x = np.stack(w.to_numpy()) if len(w) else np.zeros((0, self.length * len(self.contributors)))
        return x.astype(np.float32).reshape(-1, self.length, len(self.contributors))

    def _train(self, x: np.ndarray, check: np.ndarray) -> None:
        s, began = self.settings, time.monotonic()
        net, rng = ConvNet(len(self.contributors), self.length, s), np.random.default_rng(s.seed + 1)
        first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
        best, best_loss, waited, step = None, np.inf, 0, 0
        self.epochs_run, self.train_loss, self.validation_loss = 0, float("nan"), None
        for _ in range(s.epochs):
            if time.monotonic() - began >= s.minutes * 60:
                break
            losses = []
            for k in range(0, len(x), s.batch):
                part, trace = x[k : k + s.batch], []
                rest = net.forward(part, rng, trace) - part
                losses.append(float((rest**2).mean()))
                step += 1
                for name, grad in net.backward(trace, 2 * rest / np.float32(rest.size)).items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad**2 - second[name])
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    net.p[name] = net.p[name] - np.float32(s.learning_rate) * move
            self.epochs_run, self.train_loss = self.epochs_run + 1, float(np.mean(losses)) if losses else float("nan")
            if len(check):
                loss = float(self._squares(net, check).mean())
                if loss < best_loss:
                    best, best_loss, waited = {k: v.copy() for k, v in net.p.items()}, loss, 0
                elif (waited := waited + 1) >= s.patience:
                    break
        if best is not None:
            net.p, self.validation_loss = best, best_loss
        self.net, self.fitted, self.elapsed_s = net, True, time.monotonic() - began

    def _squares(self, net: ConvNet, x: np.ndarray) -> np.ndarray:
        """Mean squared error by window and channel, a few batches at a time."""
        at_once = 16 * self.settings.batch
        parts = [((net.forward(x[k : k + at_once]) - x[k : k + at_once]) ** 2).mean(axis=1) for k in range(0, len(x), at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.contributors)), dtype=np.float32)

    def _errors(self, w: pd.Series) -> np.ndarray:
        return self._squares(self.net, self._windows(w)).astype(float)
