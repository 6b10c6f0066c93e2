"""Scalar functions on embedding arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def normalized(a: Column | str) -> Column:
    """L2-normalised in single precision; vectors of norm 1e-30 or less stay as they are."""
    a = F.col(a) if isinstance(a, str) else a
    return F.when(norm(a) > 1e-30, F.transform(a, lambda z: (z.cast("float") * (1 / norm(a)).cast("float")).cast("float"))).otherwise(a)


def nonzero(a: Column | str) -> Column:
    return norm(a) > 1e-12


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def block_norms(a: Column | str, dim: int, blocks: int = 8) -> Column:
    """Norms of what follows each block, the last being 0."""
    blocks = max(1, min(blocks, dim))
    a = F.col(a) if isinstance(a, str) else a
    return F.array(*[norm(F.slice(a, (b + 1) * dim // blocks + 1, dim)) if b + 1 < blocks else F.lit(0.0) for b in range(blocks)])


def bounded_dot(a: Column | str, q: Sequence[float], tau: float, blocks: int = 8, slack: float = 1e-9) -> Column:
    """The dot product with q, or null once what is left can't lift it to tau (Cauchy-Schwarz after each block)."""
    dim = len(q)
    blocks = max(1, min(blocks, dim))
    a = F.col(a) if isinstance(a, str) else a
    cut = [b * dim // blocks for b in range(blocks + 1)]
    parts = [dot(F.slice(a, lo + 1, hi - lo), literal(q[lo:hi])) for lo, hi in zip(cut, cut[1:], strict=False)]
    rest_q = [sum(float(v) ** 2 for v in q[c:]) ** 0.5 for c in cut]
    out: Column = F.lit(0.0)
    reachable = F.lit(True)
    for b, part in enumerate(parts):
        out = out + part
        if b + 1 < len(parts):
            reachable = reachable & (out + norm(F.slice(a, cut[b + 1] + 1, dim)) * rest_q[b + 1] + slack >= tau)
    return F.when(reachable, out)


def shell(score: Column, tau: float, by_angle: bool = False, shells: int = 16) -> Column:
    """One of 16 shells of the cap around a query vector, by angle or by score."""
    if by_angle:
        at = angle(score) / max(1e-12, __import__("math").acos(max(-1.0, min(1.0, tau)))) * shells
    else:
        at = (1.0 - score) / max(1e-12, 1.0 - tau) * shells
    return F.least(F.lit(shells - 1), F.greatest(F.lit(0), at.cast("int")))
