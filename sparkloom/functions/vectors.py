"""Similarities of numeric arrays, within the JVM. Arrays of one pair have equal lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: str | Column) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def _each(a: Column, scalar: Column, f) -> Column:
    """f(element, scalar) for each element; the scalar is computed once for an array, not once for an element."""
    return F.zip_with(a, F.array_repeat(scalar, F.size(a)), f)


def l1_normalize(a: str | Column, *, pseudocount: float = 0.0) -> Column:
    """Each value over the sum; zeros where the sum is 0. A pseudocount is added first."""
    v = F.transform(_col(a), lambda x: x + F.lit(pseudocount)) if pseudocount else _col(a)
    return _each(v, total(v), lambda x, s: F.when(s != 0, x / s).otherwise(0.0))


def l2_normalize(a: str | Column) -> Column:
    return _each(_col(a), norm(a), lambda x, n: F.when(n != 0, x / n).otherwise(0.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; 0 if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


normalized_dot = cosine


def pearson(a: str | Column, b: str | Column) -> Column:
    """Cosine of the centred arrays."""
    centred = lambda v: _each(_col(v), total(v) / F.size(_col(v)), lambda x, m: x - m)
    return cosine(centred(a), centred(b))


def spectral_angle(a: str | Column, b: str | Column) -> Column:
    """1 - 2 * acos(cosine) / pi."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
    return 1 - 2 * F.acos(c) / math.pi


def _entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def entropy_similarity(a: str | Column, b: str | Column, *, pseudocount: float = 0.0) -> Column:
    """1 - Jensen-Shannon divergence / ln 2 of the normalised arrays."""
    p, q = l1_normalize(a, pseudocount=pseudocount), l1_normalize(b, pseudocount=pseudocount)
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return 1 - (_entropy(m) - (_entropy(p) + _entropy(q)) / 2) / math.log(2)


def kl_divergence(target: str | Column, pred: str | Column, *, pseudocount: float = 1e-9) -> Column:
    """Sum of p * ln(p / q) of the normalised arrays."""
    p, q = l1_normalize(target, pseudocount=pseudocount), l1_normalize(pred, pseudocount=pseudocount)
    return total(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)))


def multinomial_deviance(counts: str | Column, reference: str | Column, *, pseudocount: float = 1e-9) -> Column:
    """2 * sum(x * ln(p_observed / p_reference))."""
    p, q = l1_normalize(counts), l1_normalize(reference, pseudocount=pseudocount)
    terms = F.zip_with(_col(counts), F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), F.ln(x / y)).otherwise(0.0)), lambda x, y: x * y)
    return 2 * total(terms)


METRICS = {"cosine": cosine, "normalized_dot": normalized_dot, "pearson": pearson, "spectral_angle": spectral_angle, "entropy": entropy_similarity, "kld": kl_divergence, "deviance": multinomial_deviance}


def compare(a: str | Column, b: str | Column, method: str, **options) -> Column:
    """One of METRICS by name."""
    return METRICS[method](a, b, **options)
