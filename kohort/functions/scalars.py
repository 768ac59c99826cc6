"""Scalar expressions. All stay on the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python's str.strip() takes for white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MISSING = "__MISSING__"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at the ends, of which SPACES lists every character."""
    return F.btrim(_col(c), F.lit(SPACES))


def norm_id(c: Column | str) -> Column:
    """An id as stripped text; null stays null."""
    return strip(_col(c).cast("string"))


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text: lists, structs and maps as JSON, other values as they print, null as nothing."""
    kind = df.schema[name].dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    return F.coalesce(F.to_json(name) if nested else F.col(name).cast("string"), F.lit(""))


def clip(c: Column | str, n: int) -> Column:
    """Stripped, then cut at n code points; null is empty."""
    return F.substring(strip(F.coalesce(_col(c).cast("string"), F.lit(""))), 1, n)


def category(c: Column | str) -> Column:
    s = strip(_col(c).cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit(MISSING)).otherwise(s)


def category_equal(a: Column | str, b: Column | str) -> Column:
    """1.0 for equal tokens, two missing ones included."""
    return (F.coalesce(_col(a), F.lit(MISSING)) == F.coalesce(_col(b), F.lit(MISSING))).cast("double")


def minmax_norm(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    return F.when(_col(hi) <= _col(lo), F.lit(0.0)).otherwise((_col(x) - _col(lo)) / (_col(hi) - _col(lo)))


def clip01(c: Column | str) -> Column:
    """Into [0, 1]; what is no number is 0."""
    x = _col(c).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


def sigmoid(z: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(z)))


def distance(score: Column | str) -> Column:
    return 1.0 - _col(score)


def choose2(n: Column | str) -> Column:
    """Pairs of n things, exact: half of the even one of n and n - 1 times the other, as decimal(38,0)."""
    n = _col(n).cast("long")
    return (F.shiftright(n, 1).cast("decimal(18,0)") * (n - 1 + n.bitwiseAND(F.lit(1))).cast("decimal(19,0)")).cast("decimal(38,0)")


def cluster_f1(common: Column | str, a: Column | str, b: Column | str) -> Column:
    return 2.0 * _col(common) / (_col(a) + _col(b))


def dot(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """Inner product in double precision; with a known short length it is unrolled into generated code."""
    a, b = _col(a), _col(b)
    if dim is not None and dim <= 64:
        total = F.lit(0.0)
        for i in range(dim):
            total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str, dim: int | None = None) -> Column:
    return F.sqrt(dot(v, v, dim))


def cosine(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """0.0 if either norm is 0 or a side is null."""
    n = norm(a, dim) * norm(b, dim)
    return F.coalesce(F.when(n > 0, dot(a, b, dim) / n), F.lit(0.0))


def l2_normalise(v: Column | str) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_col(v), lambda x: x.cast("double") / n)).otherwise(F.transform(_col(v), lambda x: x.cast("double")))


def fuse_score(text: Column | str, event: Column | str, mode: str = "max", w_text: float = 0.5, lambda_min: float = 0.2) -> Column:
    """Of two routes; where one is missing the other stands alone. Modes max, mean, wavg, maxmin."""
    a, b = _col(text), _col(event)
    either = F.coalesce(a, b)
    both = {
        "max": F.greatest(a, b),
        "mean": (a + b) / 2.0,
        "wavg": a * w_text + b * (1.0 - w_text),
        "maxmin": F.greatest(a, b) + F.least(a, b) * lambda_min,
    }
    if mode not in both:
        raise ValueError(f"unknown fusion {mode!r}")
    return F.when(a.isNotNull() & b.isNotNull(), both[mode]).otherwise(either)


def first_present(*names: str) -> Column:
    """The first of several fields that is not null."""
    return F.coalesce(*[F.col(n) for n in names])


def integer_grid(low: float, high: float, step: float = 0.01) -> list[float]:
    """Thresholds in whole hundredths, the upper end included where a step meets it; low must be under high."""
    lo, hi, by = (Decimal(str(x)) * 100 for x in (low, high, step))
    if any(x != int(x) for x in (lo, hi, by)) or not lo < hi or by <= 0:
        raise ValueError("thresholds and step are hundredths, the lower end under the upper one")
    return [n / 100 for n in range(int(lo), int(hi) + 1, int(by))]


def theta_grid(low: str | float = "0.10", high: str | float = "0.95", step: str | float = "0.01") -> list[float]:
    """Thresholds in decimal steps, the upper end included."""
    lo, hi, by = (Decimal(str(x)) for x in (low, high, step))
    if not (0 < lo <= hi <= 1) or by <= 0:
        raise ValueError("thresholds must satisfy 0 < low <= high <= 1 and step > 0")
    n = int((hi - lo) / by)
    grid = [lo + by * i for i in range(n + 1)]
    return [float(x) for x in grid + [hi] * (grid[-1] < hi)]
