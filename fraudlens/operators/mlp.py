"""Multilayer perceptron (M4) trained over the partitions of a table.

One logistic output unit, log loss and an L2 penalty ``alpha / (2 n) |W|^2``.
The training rows are written once, dealt over slices of ``SLICE_ROWS`` rows
by a hash of their id, as blocks of raw numbers that a pass need not decode;
the parameter vector goes out with each job.

* ``lbfgs``: each task sums loss and gradient of its rows, Spark adds the
  sums up in a tree, and the driver keeps the last few steps of the parameter
  vector (its size does not depend on the rows). It wants sums alone, so a table
  of several slices is dealt over smaller ones, of ``SUM_ROWS`` rows.
* ``adam`` and ``sgd``: each slice runs whole epochs of mini-batches from the
  common parameters and moments, which are averaged by rows after each round.
  One slice is plain sequential training.

Both end by tolerance, and say in how many steps, or that ``max_iter`` was
used up. Rows whose features are null are not trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.operators.sums import summed
from fraudlens.session import write_table

SLICE_ROWS, BATCH_ROWS = 65_536, 200
#: Rows of a slice that is only summed over, and of a stored block.
SUM_ROWS, BLOCK_ROWS = 16_384, 8192
#: Epochs of a slice between two averages; partial results that one task adds up.
LOCAL_EPOCHS, FAN_IN = 5, 64
ACTIVATIONS = ("relu", "tanh", "sigmoid")


@dataclass(frozen=True)
class Net:
    """Layer sizes (features first, the output unit last) and hidden activation."""

    sizes: tuple[int, ...]
    activation: str = "relu"

    def layers(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and biases of each layer, as views of the vector."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def start(self, seed: int) -> np.ndarray:
        """Seeded uniform start values, wider for layers with fewer units."""
        rng = np.random.default_rng(seed)
        factor = 2.0 if self.activation == "sigmoid" else 6.0
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            parts.append(rng.uniform(-1.0, 1.0, size=a * b + b) * np.sqrt(factor / (a + b)))
        return np.concatenate(parts)

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for biases."""
        return np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(self.sizes, self.sizes[1:])])

    def _hidden(self, z: np.ndarray) -> np.ndarray:
        if self.activation == "relu":
            return np.maximum(z, 0.0)
        return np.tanh(z) if self.activation == "tanh" else 0.5 * (1.0 + np.tanh(0.5 * z))

    def _slope(self, h: np.ndarray) -> np.ndarray:
        """Derivative of the hidden activation, from its value."""
        if self.activation == "relu":
            return (h > 0).astype(float)
        return 1.0 - h * h if self.activation == "tanh" else h * (1.0 - h)

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Values of all layers and the output's logit."""
        layers, values = self.layers(theta), [x]
        for w, b in layers[:-1]:
            values.append(self._hidden(values[-1] @ w + b))
        w, b = layers[-1]
        return values, (values[-1] @ w + b)[:, 0]

    def loss_gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums of the log loss and its gradient over the rows."""
        values, z = self.forward(theta, x)
        loss = float(np.sum(np.logaddexp(0.0, z) - y * z))
        delta = (0.5 * (1.0 + np.tanh(0.5 * z)) - y)[:, None]
        grads = []
        for i, (w, _) in reversed(list(enumerate(self.layers(theta)))):
            grads.append((values[i].T @ delta, delta.sum(axis=0)))
            if i:
                delta = (delta @ w.T) * self._slope(values[i])
        return loss, np.concatenate([np.concatenate([gw.ravel(), gb]) for gw, gb in reversed(grads)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, x, y) as blocks of at most ``BLOCK_ROWS`` rows of a slice."""
    for whole in batches:
        for a in range(0, whole.num_rows, BLOCK_ROWS):
            b = whole.slice(a, BLOCK_ROWS)
            k = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            y = b.column(2).to_numpy().astype(float)
            cuts = np.r_[0, np.flatnonzero(np.diff(k)) + 1, len(k)]
            parts = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for i, _ in parts], pa.int64()), pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()),
                                              pa.array([y[i:j].tobytes() for i, j in parts], pa.binary())], names=["slice", "x", "y"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, x, y) of the stored blocks."""
    for b in batches:
        for k, x, y in zip(*b.columns):
            y = np.frombuffer(y.as_buffer(), dtype=float)
            yield k.as_py(), np.frombuffer(x.as_buffer(), dtype=float).reshape(len(y), -1), y


class Table:
    """The training rows, dealt and written once. Where ``sums`` are all that is
    wanted of several slices, they are dealt over smaller ones."""

    def __init__(self, train: DataFrame, id_col: str, features: str, label: str, sums: bool = False):
        rows = train.where(F.col(features).isNotNull()).select(
            F.xxhash64(id_col).alias("h"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
        self.n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        slices = max(1, -(-self.n // SLICE_ROWS))
        if sums and slices > 1:
            slices = -(-self.n // min(SUM_ROWS, SLICE_ROWS))
        dealt = rows.withColumn("slice", F.pmod("h", F.lit(slices))).repartitionById(slices, F.col("slice").cast("int")).sortWithinPartitions("slice", "h")
        self.rows = write_table(dealt.select("slice", "x", "y").mapInArrow(_packed, "slice long, x binary, y binary"), "mlp-train")
        self.tasks = slices
        self.width = width or 0

    def gradient(self, net: Net, theta: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        """Mean loss with penalty, and its gradient."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(theta))
            for _, x, y in _blocks(batches):
                loss, g = net.loss_gradient(theta, x, y)
                total[0] += loss
                total[1:] += g
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        parts = self.rows.mapInArrow(run, "part long, v binary").withColumn("part", F.spark_partition_id().cast("long"))
        total = summed(parts, self.tasks, FAN_IN) / self.n
        w = theta * net.penalised()
        return total[0] + 0.5 * alpha / self.n * float(w @ w), total[1:] + alpha / self.n * w

    def epochs(self, net: Net, state: np.ndarray, alpha: float, step: Callable, epochs: int, first: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """State after ``epochs`` local epochs, averaged by rows, and the mean
        loss of each epoch. ``step(state, gradient)`` changes a state in place."""
        n_theta = len(net.start(0))
        decay = alpha * net.penalised()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for k, x, y in _blocks(batches):
                held.setdefault(k, []).append((x, y))
            total = None
            for k, parts in sorted(held.items()):
                x, y = (np.concatenate(p) for p in zip(*parts))
                own, losses = state.copy(), []
                for e in range(epochs):
                    order, loss = np.random.default_rng([seed, first + e, k]).permutation(len(x)), 0.0
                    for a in range(0, len(x), BATCH_ROWS):
                        i = order[a:a + BATCH_ROWS]
                        some, g = net.loss_gradient(own[:n_theta], x[i], y[i])
                        w = own[:n_theta] * decay
                        loss += some + 0.5 * float(w @ own[:n_theta])
                        step(own, (g + w) / len(i))
                    losses.append(loss)
                out = np.r_[float(len(x)), np.array(losses), own * len(x)]
                total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        parts = self.rows.mapInArrow(run, "part long, v binary").withColumn("part", F.spark_partition_id().cast("long"))
        total = summed(parts, self.tasks, FAN_IN)
        return total[1 + epochs:] / total[0], total[1:1 + epochs] / total[0]


def lbfgs(table: Table, net: Net, theta: np.ndarray, alpha: float, max_iter: int, tol: float, memory: int = 10) -> tuple[np.ndarray, int, bool]:
    """Limited-memory BFGS with a backtracking line search: parameters, steps,
    and whether the largest slope fell below ``tol`` or the loss settled."""
    f, g = table.gradient(net, theta, alpha)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for it in range(max_iter):
        if np.abs(g).max() <= tol:
            return theta, it, True
        q, back = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            back.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y, r), a in zip(past, reversed(back)):
            q += (a - r * (y @ q)) * s
        slope = -(g @ q)
        if slope >= 0:  # not a way down: forget the past steps
            past, q, slope = [], g / max(1.0, np.abs(g).sum()), -(g @ g) / max(1.0, np.abs(g).sum())
        t = 1.0
        for _ in range(30):
            new = theta - t * q
            f2, g2 = table.gradient(net, new, alpha)
            if f2 <= f + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            return theta, it, True  # no lower point along the way down
        s, y = new - theta, g2 - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past[1 - memory:], (s, y, 1.0 / (s @ y))]
        settled = f - f2 <= 1e-9 * max(abs(f), abs(f2), 1.0)
        theta, f, g = new, f2, g2
        if settled:
            return theta, it + 1, True
    return theta, max_iter, bool(np.abs(g).max() <= tol)


def stochastic(table: Table, net: Net, theta: np.ndarray, alpha: float, max_iter: int, tol: float, solver: str, rate: float, schedule: str,
               seed: int, patience: int = 10) -> tuple[np.ndarray, int, bool]:
    """adam or sgd (momentum 0.9) by epochs: parameters, epochs, and whether
    the loss had stopped falling by ``tol`` for ``patience`` epochs. With the
    adaptive schedule sgd divides its rate by 5 then, down to 1e-6."""
    n = len(theta)
    state = np.r_[theta, np.zeros(2 * n + 1 if solver == "adam" else n)]
    best, waited, done = np.inf, 0, 0
    while done < max_iter:
        def adam(s, g, rate=rate):
            s[-1] += 1
            m, v = s[n:2 * n], s[2 * n:3 * n]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            s[:n] -= rate * np.sqrt(1 - 0.999 ** s[-1]) / (1 - 0.9 ** s[-1]) * m / (np.sqrt(v) + 1e-8)

        def sgd(s, g, rate=rate):
            v = s[n:2 * n]
            v *= 0.9
            v -= rate * g
            s[:n] += 0.9 * v - rate * g

        epochs = min(LOCAL_EPOCHS, max_iter - done)
        state, losses = table.epochs(net, state, alpha, adam if solver == "adam" else sgd, epochs, done, seed)
        done += epochs
        for loss in losses:
            waited = 0 if loss < best - tol else waited + 1
            best = min(best, loss)
        if waited >= patience:
            if solver == "adam" or schedule != "adaptive" or rate <= 1e-6:
                return state[:n], done, True
            rate, waited = rate / 5.0, 0
    return state[:n], done, False


def train_mlp(train: DataFrame, id_col: str, features: str, label: str, hidden: tuple, activation: str, solver: str, alpha: float, schedule: str,
              rate: float, max_iter: int, tol: float, seed: int) -> tuple[Net, np.ndarray, int, bool]:
    """The trained net: layers, parameters, steps, converged."""
    table = Table(train, id_col, features, label, sums=solver == "lbfgs")
    net = Net((table.width, *hidden, 1), activation)
    theta = net.start(seed)
    if solver == "lbfgs":
        return net, *lbfgs(table, net, theta, alpha, max_iter, tol)
    return net, *stochastic(table, net, theta, alpha, max_iter, tol, solver, rate, schedule, seed)
