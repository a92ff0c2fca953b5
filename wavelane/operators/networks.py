"""Regressors of whole windows by convolutions, recurrence or attention, for ``training.Training``.

Each is a function of one vector of weights and some rows, with its gradient worked out by hand, so tasks need numpy only and Spark adds up
what they find. Rows are independent of each other: there is no normalization over a batch, whose statistics would need a pass over
all partitions for each layer and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rows that are worked on at once, which bounds a task's memory.
ROWS = 256

Parts = dict[str, np.ndarray]
Back = Callable[[np.ndarray], Parts]


class Network:
    """Weights by name within one vector; ``forward`` gives a value for each row, and what turns its slope into the weights' gradient."""

    def __init__(self, inputs: int, shapes: dict[str, tuple[int, ...]]):
        self.inputs, self.shapes = inputs, shapes | {"centre": (1,)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())

    def forward(self, p: Parts, x: np.ndarray) -> tuple[np.ndarray, Back]:
        raise NotImplementedError

    def parts(self, w: np.ndarray) -> Parts:
        edges = np.cumsum([int(np.prod(s)) for s in self.shapes.values()])[:-1]
        return {n: v.reshape(s) for (n, s), v in zip(self.shapes.items(), np.split(w, edges), strict=True)}

    def start(self, seed: int, centre: float) -> np.ndarray:
        """Matrices with a variance of one over their inputs, nothing in all biases but the last."""
        rng = np.random.default_rng(seed)
        first = [rng.normal(0, s[0] ** -0.5, s).ravel() if len(s) > 1 else np.zeros(s) for s in self.shapes.values()]
        return np.concatenate([*first[:-1], [centre]])

    def _slices(self, x: np.ndarray) -> Iterator[slice]:
        return (slice(a, a + ROWS) for a in range(0, len(x), ROWS))

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = self.parts(w)
        return np.concatenate([np.zeros(0), *(self.forward(p, x[s])[0] for s in self._slices(x))])

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of absolute errors and its gradient."""
        p, loss, slope = self.parts(w), 0.0, np.zeros(self.size)
        for s in self._slices(x):
            out, back = self.forward(p, x[s])
            loss += float(np.abs(out - y[s]).sum())
            own = back(np.sign(out - y[s]))
            slope += np.concatenate([own[n].ravel() for n in self.shapes])
        return loss, slope


def _head(p: Parts, last: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, Parts]]]:
    """A linear value of each row, and from its slope that of the row and of the head."""
    return last @ p["head"][:, 0] + p["centre"][0], lambda d: (np.outer(d, p["head"][:, 0]), {"head": (last.T @ d)[:, None], "centre": d.sum(keepdims=True)})


class Convolutions(Network):
    """Layers of convolution, rectification and the larger of every two neighbours, then a linear head on what is left of the window (M1 without batch norm).

    A window has at least two to the power of the number of layers; a sample without a neighbour is left out.
    """

    def __init__(self, inputs: int, channels: tuple[int, ...] = (32, 64, 128), width: int = 8):
        if inputs >> len(channels) < 1:
            raise ValueError("the window is too short for so many layers")
        self.channels, self.width = channels, width
        shapes, before = {}, 1
        for k, c in enumerate(channels):
            shapes |= {f"kernel{k}": (before * width, c), f"bias{k}": (c,)}
            before = c
        super().__init__(inputs, shapes | {"head": ((inputs >> len(channels)) * before, 1)})

    def forward(self, p: Parts, x: np.ndarray) -> tuple[np.ndarray, Back]:
        a, kept = x[:, :, None], []
        left = (self.width - 1) // 2
        for k in range(len(self.channels)):
            n, t, c = a.shape
            padded = np.pad(a, ((0, 0), (left, self.width - 1 - left), (0, 0)))
            around = np.lib.stride_tricks.sliding_window_view(padded, self.width, axis=1).reshape(n, t, c * self.width)
            z = around @ p[f"kernel{k}"] + p[f"bias{k}"]
            pairs = np.maximum(z[:, : t // 2 * 2], 0).reshape(n, t // 2, 2, -1)
            pick = pairs.argmax(axis=2)[:, :, None]
            a = np.take_along_axis(pairs, pick, 2)[:, :, 0]
            kept.append((around, z, pick, c))
        out, head = _head(p, a.reshape(len(x), -1))

        def back(d: np.ndarray) -> Parts:
            slope, g = head(d)
            slope = slope.reshape(a.shape)
            for k in reversed(range(len(kept))):
                around, z, pick, c = kept[k]
                n, t, wide = z.shape
                pairs = np.zeros((n, t // 2, 2, wide))
                np.put_along_axis(pairs, pick, slope[:, :, None], 2)
                of_z = np.zeros_like(z)
                of_z[:, : t // 2 * 2] = pairs.reshape(n, -1, wide)
                of_z *= z > 0
                g |= {f"kernel{k}": np.tensordot(around, of_z, ((0, 1), (0, 1))), f"bias{k}": of_z.sum(axis=(0, 1))}
                of_around = (of_z @ p[f"kernel{k}"].T).reshape(n, t, c, self.width)
                of_padded = np.zeros((n, t + self.width - 1, c))
                for j in range(self.width):
                    of_padded[:, j : j + t] += of_around[..., j]
                slope = of_padded[:, left : left + t]
            return g

        return out, back


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Recurrent(Network):
    """Layers of long short-term memory over ``step`` samples at a time; the last state goes to a linear head (M4)."""

    def __init__(self, inputs: int, step: int = 8, hidden: int = 256, layers: int = 2):
        if inputs % step:
            raise ValueError("the window is no whole number of steps")
        self.step, self.hidden, self.layers = step, hidden, layers
        shapes = {}
        for k in range(layers):
            shapes |= {f"gates{k}": ((hidden if k else step) + hidden, 4 * hidden), f"bias{k}": (4 * hidden,)}
        super().__init__(inputs, shapes | {"head": (hidden, 1)})

    def _layer(self, matrix: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, Callable]:
        n, steps, wide = x.shape
        size = self.hidden
        h, c, kept, out = np.zeros((n, size)), np.zeros((n, size)), [], np.empty((n, steps, size))
        for t in range(steps):
            v = np.concatenate([x[:, t], h], axis=1)
            z = v @ matrix + bias
            let_in, keep, show = np.split(_logistic(z[:, : 3 * size]), 3, axis=1)
            new = np.tanh(z[:, 3 * size :])
            before, c = c, keep * c + let_in * new
            shown = np.tanh(c)
            h = out[:, t] = show * shown
            kept.append((v, let_in, keep, show, new, before, shown))

        def back(of_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            of_x, of_h, of_c = np.empty_like(x), np.zeros((n, size)), np.zeros((n, size))
            of_matrix, of_bias = np.zeros_like(matrix), np.zeros_like(bias)
            for t in reversed(range(steps)):
                v, let_in, keep, show, new, before, shown = kept[t]
                of_h = of_h + of_out[:, t]
                of_c = of_c + of_h * show * (1 - shown**2)
                of_z = np.concatenate([of_c * new * let_in * (1 - let_in), of_c * before * keep * (1 - keep), of_h * shown * show * (1 - show), of_c * let_in * (1 - new**2)], axis=1)
                of_matrix += v.T @ of_z
                of_bias += of_z.sum(axis=0)
                of_v = of_z @ matrix.T
                of_x[:, t], of_h, of_c = of_v[:, :wide], of_v[:, wide:], of_c * keep
            return of_x, of_matrix, of_bias

        return out, back

    def forward(self, p: Parts, x: np.ndarray) -> tuple[np.ndarray, Back]:
        a, backs = x.reshape(len(x), -1, self.step), []
        for k in range(self.layers):
            a, layer_back = self._layer(p[f"gates{k}"], p[f"bias{k}"], a)
            backs.append(layer_back)
        out, head = _head(p, a[:, -1])

        def back(d: np.ndarray) -> Parts:
            last, g = head(d)
            slope = np.zeros(a.shape)
            slope[:, -1] = last
            for k in reversed(range(self.layers)):
                slope, g[f"gates{k}"], g[f"bias{k}"] = backs[k](slope)
            return g

        return out, back


def _levelled(x: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Each place's numbers with mean 0 and deviation 1."""
    spread = np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    y = (x - x.mean(axis=-1, keepdims=True)) / spread
    return y, lambda d: (d - d.mean(axis=-1, keepdims=True) - y * (d * y).mean(axis=-1, keepdims=True)) / spread


def _by_matrix(x: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    return x @ matrix, lambda d: (d @ matrix.T, np.tensordot(x, d, ((0, 1), (0, 1))))


class Attention(Network):
    """A transformer's blocks over patches of the window, whose mean goes to a linear head (M5). Each block levels, attends and adds, then levels, rectifies and adds."""

    def __init__(self, inputs: int, patch: int = 8, width: int = 128, depth: int = 4, heads: int = 4):
        if inputs % patch or width % heads:
            raise ValueError("the window is no whole number of patches, or the width no whole number of heads")
        self.patch, self.width, self.depth, self.heads = patch, width, depth, heads
        shapes: dict[str, tuple[int, ...]] = {"embed": (patch, width), "bias": (width,), "places": (inputs // patch, width)}
        for k in range(depth):
            shapes |= {f"asks{k}": (width, 3 * width), f"tells{k}": (width, width), f"up{k}": (width, 2 * width), f"up_bias{k}": (2 * width,), f"down{k}": (2 * width, width)}
        super().__init__(inputs, shapes | {"head": (width, 1)})

    def _attend(self, asks: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        n, t, _ = asks.shape
        q, k, v = np.moveaxis(asks.reshape(n, t, 3, self.heads, -1), (2, 3), (0, 2))
        scale = q.shape[-1] ** -0.5
        score = q @ k.swapaxes(-1, -2) * scale
        share = np.exp(score - score.max(axis=-1, keepdims=True))
        share /= share.sum(axis=-1, keepdims=True)

        def back(d: np.ndarray) -> np.ndarray:
            of = d.reshape(n, t, self.heads, -1).swapaxes(1, 2)
            of_share = of @ v.swapaxes(-1, -2)
            of_score = share * (of_share - (of_share * share).sum(axis=-1, keepdims=True)) * scale
            every = np.stack([of_score @ k, of_score.swapaxes(-1, -2) @ q, share.swapaxes(-1, -2) @ of])
            return np.moveaxis(every, (0, 2), (2, 3)).reshape(n, t, -1)

        return (share @ v).swapaxes(1, 2).reshape(n, t, -1), back

    def forward(self, p: Parts, x: np.ndarray) -> tuple[np.ndarray, Back]:
        patches = x.reshape(len(x), -1, self.patch)
        a, of_embed = _by_matrix(patches, p["embed"])
        a, backs = a + p["bias"] + p["places"], []
        for k in range(self.depth):
            level, of_level = _levelled(a)
            asks, of_asks = _by_matrix(level, p[f"asks{k}"])
            met, of_met = self._attend(asks)
            told, of_told = _by_matrix(met, p[f"tells{k}"])
            a = a + told
            again, of_again = _levelled(a)
            up, of_up = _by_matrix(again, p[f"up{k}"])
            up = up + p[f"up_bias{k}"]
            down, of_down = _by_matrix(np.maximum(up, 0), p[f"down{k}"])
            a = a + down
            backs.append((of_level, of_asks, of_met, of_told, of_again, of_up, up > 0, of_down))
        out, head = _head(p, a.mean(axis=1))

        def back(d: np.ndarray) -> Parts:
            last, g = head(d)
            slope = np.repeat(last[:, None] / a.shape[1], a.shape[1], axis=1)
            for k in reversed(range(self.depth)):
                of_level, of_asks, of_met, of_told, of_again, of_up, over, of_down = backs[k]
                part, g[f"down{k}"] = of_down(slope)
                part = part * over
                g[f"up_bias{k}"] = part.sum(axis=(0, 1))
                part, g[f"up{k}"] = of_up(part)
                slope = slope + of_again(part)
                part, g[f"tells{k}"] = of_told(slope)
                part, g[f"asks{k}"] = of_asks(of_met(part))
                slope = slope + of_level(part)
            g["bias"], g["places"] = slope.sum(axis=(0, 1)), slope.sum(axis=0)
            g["embed"] = of_embed(slope)[1]
            return g

        return out, back
