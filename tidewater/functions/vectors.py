"""Column builders on arrays of doubles: activations, softmax, products, choices.  None starts a job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Activations by name.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
    "prelu": lambda x: F.when(x < 0, x * 0.02).otherwise(x),
}
#: Their slopes, of the input.
SLOPES: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: F.lit(1.0),
    "sigmoid": lambda x: ACTIVATIONS["sigmoid"](x) * (1 - ACTIVATIONS["sigmoid"](x)),
    "tanh": lambda x: 1 - F.tanh(x) * F.tanh(x),
    "relu": lambda x: F.when(x > 0, 1.0).otherwise(0.0),
    "leaky": lambda x: F.when(x > 0, 1.0).otherwise(0.01),
    "elu": lambda x: F.when(x > 0, 1.0).otherwise(F.exp(x)),
    "prelu": lambda x: F.when(x < 0, 0.02).otherwise(1.0),
}


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with the value worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def shares(a: Column) -> Column:
    """The values as shares of their sum; null for a sum of 0."""
    return let(F.struct(a.alias("a"), total(a).alias("t")), lambda s: F.transform(s["a"], lambda x: F.try_divide(x, s["t"])))


def softmax(a: Column) -> Column:
    """exp(x - max) over its sum, so that large values don't overflow."""
    e = let(F.struct(a.alias("a"), F.array_max(a).alias("m")), lambda s: F.transform(s["a"], lambda x: F.exp(x - s["m"])))
    return shares(e)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def dense(a: Column, weights: Sequence[Sequence[float]], activation: str = "linear") -> Column:
    """One layer: a row of weights for each output, the last of them the bias."""
    f = ACTIVATIONS[activation]
    wide = F.concat(a, F.array(F.lit(1.0)))
    return F.array(*[f(dot(wide, F.array(*[F.lit(float(w)) for w in row]))) for row in weights])


def argmax(a: Column) -> Column:
    """The first position (from 0) of the largest value."""
    return F.array_position(a, F.array_max(a)) - 1


def td_target(reward: Column, done: Column, q: Column, gamma: float) -> Column:
    return reward + F.when(done, 0.0).otherwise(gamma * F.array_max(q))


def epsilon_greedy(q: Column, eps: float) -> Column:
    """Probability of each action: eps shared out evenly, the rest on the best."""
    best = argmax(q)
    return F.transform(q, lambda _, k: eps / F.size(q) + F.when(k == best, 1 - eps).otherwise(0.0))


def softmax_jacobian(s: Column) -> Column:
    """The rows s_i (delta_ij - s_j) of the derivative, for the softmax s of a vector."""
    return F.transform(s, lambda x, i: F.transform(s, lambda y, j: x * (F.when(i == j, 1.0).otherwise(0.0) - y)))


def power_off_diagonal(m: Column, e: float) -> Column:
    """Each cell of a matrix to the power e, the diagonal 0."""
    return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, 0.0).otherwise(F.pow(x, F.lit(e)))))


def masked_argmax(a: Column, mask: Column) -> Column:
    """The first position (from 0) of the largest value where the mask is true; null if it nowhere is."""
    open_ = F.filter(F.zip_with(a, mask, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda s: s["m"])
    best = F.array_max(F.transform(open_, lambda s: s["x"]))
    pairs = F.zip_with(a, mask, lambda x, m: F.when(m, x))
    return F.when(F.size(open_) > 0, F.array_position(pairs, best) - 1)


def last_true(a: Column) -> Column:
    """The last position (from 0) of true, -1 without one."""
    back = F.array_position(F.reverse(a), True)
    return F.when(back > 0, F.size(a) - back).otherwise(-1)


def transition_probability(tau: Column, eta: Column, alpha: float, beta: float) -> Column:
    """tau^alpha eta^beta as shares of their sum."""
    return shares(F.zip_with(tau, eta, lambda t, h: F.pow(t, F.lit(alpha)) * F.pow(h, F.lit(beta))))


def gather(a: Column, i: Column) -> Column:
    """The value at position i (from 0); null outside."""
    return F.get(a, i)


def power_spectrum(a: Column, n: int | None = None) -> Column:
    """|sum_i x_i exp(-2 pi i k i / n)|^2 for k = 0 .. n/2 of a short array, n its length unless given; nulls in it count for
    nothing, an array of them alone gives nulls, an empty one nothing.  For series use operators.signal.spectrum."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def powers(a: pa.Array) -> pa.Array:
        """By the matrix products of all arrays of one length with the cosines and sines."""
        size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        values = a.flatten()
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        x = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        at = np.concatenate([[0], np.cumsum(np.where(size > 0, (size if n is None else n) // 2 + 1, 0))])
        out, none = np.zeros(at[-1]), np.zeros(at[-1], bool)
        for s in np.unique(size[size > 0]):
            rows, m = np.flatnonzero(size == s), n or int(s)
            turn = 2 * np.pi / m * (np.outer(np.arange(s), np.arange(m // 2 + 1)) % m)
            cells = start[rows][:, None] + np.arange(s)
            to = at[rows][:, None] + np.arange(m // 2 + 1)
            out[to] = (x[cells] @ np.cos(turn)) ** 2 + (x[cells] @ np.sin(turn)) ** 2
            none[to] = ~known[cells].any(axis=1, keepdims=True)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, mask=none))

    return powers(a)
