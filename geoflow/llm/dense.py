"""Exact products of integer matrices by BLAS."""

from __future__ import annotations

import numpy as np

#: Whole numbers below this are exact in float64, and so are sums of them that stay below it.
EXACT = 1 << 53


def largest(values: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of int64 matrices, exact.

    If no partial sum can reach 2^53, in whatever order the products are added, float64
    BLAS is exact and used. Otherwise the inner dimension is halved until the parts are
    below it; single columns beyond it are multiplied as Python numbers. A result that
    does not fit into 64 bits raises ``OverflowError``.
    """
    n = left.shape[1]
    bound = n * largest(left) * largest(right)
    if bound < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if n == 1 or bound >= 1 << 63:
        total = left.astype(object) @ right.astype(object).T
        if largest(total) >= 1 << 63:
            raise OverflowError("an inner product does not fit into 64 bits")
        return total.astype(np.int64)
    half = n // 2
    return exact_product(left[:, :half], right[:, :half]) + exact_product(left[:, half:], right[:, half:])
