"""Scalar column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def canonical_gene(gene: Column) -> Column:
    return F.upper(F.trim(gene))


def clip_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "t"), F.lit(False))


def file_stem(path: Column) -> Column:
    """Base name without its last suffix and without a trailing graph mark."""
    base = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.replace(base, F.lit("_graph"), F.lit(""))


def gaussian_decay(dist: Column, bandwidth: Column) -> Column:
    return F.exp(-(dist * dist) / (F.lit(2.0) * bandwidth * bandwidth))


def log2_enrichment(observed: Column, expected: Column) -> Column:
    return F.log2((observed + EPS) / (expected + EPS))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def log_cosh(x: Column) -> Column:
    """ln(cosh x) without overflow."""
    a = F.abs(x)
    return a + F.log1p(F.exp(-2.0 * a)) - math.log(2.0)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value for whole degrees of freedom, by the finite series."""
    theta = F.atan(F.try_divide(F.abs(t), F.sqrt(df)))
    s, c2 = F.sin(theta), F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    terms = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    start = F.struct(F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(j == 0, F.lit(1.0)).when(odd, 2.0 * j / (2.0 * j + 1.0) * c2).otherwise((2.0 * j - 1.0) / (2.0 * j) * c2)
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.when(terms >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(terms, F.lit(0))), start, step,
                                            lambda acc: acc["sum"])).otherwise(F.lit(0.0))
    area = F.when(odd, F.lit(2.0 / math.pi) * (theta + s * series)).otherwise(s * series)
    return F.greatest(F.lit(1.0) - area, F.lit(0.0))


def cosine_ramp(pressure: Column) -> Column:
    return 0.5 * (1.0 - F.cos(F.lit(math.pi) * pressure))


def scale_ramp(progress: Column, start: float, end: float) -> Column:
    return F.lit(start) + (end - start) * F.pow(progress, F.lit(0.8))


def temperature_ramp(progress: Column, start: float, end: float) -> Column:
    return F.lit(end) + (start - end) * F.pow(1.0 - progress, F.lit(1.5))


def alpha_ramp(progress: Column, start: float, end: float) -> Column:
    return F.lit(start) + (end - start) * progress


def interface_label(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("<->"), b)


def interface_ends(label: Column) -> Column:
    return F.split(label, "<->")


def node_label(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def leading_number(name: Column) -> Column:
    """Number a program name starts with; names without one sort last."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")), F.lit("999999999"))
                      .cast("int"), F.lit(999))


def matrix_cell(effect: Column, robust: Column, q: Column) -> Column:
    return F.format_string("Eff:%.3f | %s | %.3f", effect, robust, q)
