"""Column functions over array-valued features and class probabilities. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest probability in logarithms.
FLOOR = 1e-12
#: Smallest norm that a row is divided by.
NORM_FLOOR = 1e-9
EARTH_RADIUS_M = 6371000.0


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2(v: Column) -> Column:
    """The vector over its length, which counts as NORM_FLOOR at least."""
    n = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x / n)


def early_fusion(*parts: Column) -> Column:
    """Each modality scaled to length one, then joined."""
    return F.concat(*[l2(p) for p in parts])


def late_fusion(a: Column, b: Column, weight: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x + (1.0 - weight) * y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two rows; one where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(dot(a, b) / n)


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return normalised(e)


def normalised(v: Column) -> Column:
    s = total(v)
    return F.transform(v, lambda x: x / s)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def two_class(x: Column) -> Column:
    """Probabilities of classes 0 and 1 from the log odds of class 1."""
    return F.array(1 - sigmoid(x), sigmoid(x))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(FLOOR)))))


def argmax(v: Column) -> Column:
    """Zero-based place of the largest value, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(k: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == k, 1.0).otherwise(0.0))


def squared_error(p: Column, k: Column, classes: int) -> Column:
    return total(F.zip_with(p, one_hot(k, classes), lambda a, b: (a - b) * (a - b)))


def valid_probabilities(p: Column, classes: int, slack: float = 1e-8, sum_slack: float = 1e-5) -> Column:
    """True where the row has one finite probability in [0, 1] for each class and they sum to one."""
    each = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -slack) & (x <= 1 + slack))
    return (F.size(p) == classes) & F.coalesce(each, F.lit(False)) & (F.abs(total(p) - 1) <= sum_slack)


def clipped(p: Column) -> Column:
    """Probabilities cut to [0, 1] and scaled to sum to one."""
    return normalised(F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; a row without any counts one."""
    width = F.size(rows[0])
    n = F.greatest(total(doubles(mask)), F.lit(NORM_FLOOR))
    both = F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x * m))
    start = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    return F.transform(F.aggregate(both, start, lambda a, r: F.zip_with(a, r, lambda x, y: x + y)), lambda x: x / n)


def by_class(m: Column, classes: int) -> Column:
    """An ordered vector from a map of class number, as text, to value; absent classes are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.try_element_at(m, k.cast("string")), F.lit(0.0)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def appended_once(items: Column, item: str) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, F.lit(item)))


def same_number(a: Column, b: Column, slack: float) -> Column:
    """Within the slack, or both absent, or both not a number."""
    both = (a.isNull() & b.isNull()) | (F.isnan(a) & F.isnan(b))
    return F.coalesce(both | (F.abs(a - b) <= slack), F.lit(False))


def grey_code(grey: Column, wide: int = 9, high: int = 8) -> Column:
    """64 bits of an image's grey values, row by row: a bit is set where a value exceeds the one before it; the first is the lowest.

    Null unless there are wide x high values.
    """
    bits = [((F.get(grey, F.lit(r * wide + c + 1)) > F.get(grey, F.lit(r * wide + c))).cast("long"), r * (wide - 1) + c) for r in range(high) for c in range(wide - 1)]
    code = None
    for flag, at in bits:
        bit = F.shiftleft(flag, at)
        code = bit if code is None else code.bitwiseOR(bit)
    return F.when(F.size(grey) == wide * high, code)
