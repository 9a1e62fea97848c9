"""Rounding, rank statistics and vectors as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value, the same in any engine that has floor: sign * floor(|x| * 10**d + 0.5) / 10**d."""
    power = F.lit(float(10**digits))
    return F.when(x < 0, -F.floor(-x * power + 0.5) / power).otherwise(F.floor(x * power + 0.5) / power)


def nearest_rank(values: Column, q: float = 0.95) -> Column:
    """Of an array: the value at place min(n-1, round((n-1)*q)) in order, rounding half to even; 0.0 for an empty one."""
    n = F.size(values)
    place = F.least(n - 1, F.bround((n - 1) * F.lit(q), 0).cast("int"))
    return F.when(n > 0, F.element_at(F.sort_array(values), place + 1)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column, dims: int = 0) -> Column:
    """Inner product. With dims, the length that both have, it is written out and compiled; the sum is the same."""
    if dims:
        return reduce(lambda s, i: s + F.get(a, F.lit(i)) * F.get(b, F.lit(i)), range(dims), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None, dims: int = 0) -> Column:
    """Cosine within 0 and 1; null for null, empty, unequally long or zero vectors. Norms that are at hand save work; so does
    dims, the length that most vectors have."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 1e-12) & (nb > 1e-12)
    inner = F.when(F.size(a) == dims, dot(a, b, dims)).otherwise(dot(a, b)) if dims else dot(a, b)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner / (na * nb))))


def unit(a: Column) -> Column:
    """The vector at length 1; null for an empty or zero vector."""
    return F.when((F.size(a) > 0) & (norm(a) > 1e-12), F.transform(a, lambda x: x.cast("double") / norm(a)))


def gallery_similarity(left: Column, right: Column, by_size: bool = True) -> Column:
    """Mean of the best min(3, sizes, pairs) cosines between two arrays of vectors; null if there is none.

    Without by_size of the best min(3, pairs): two small galleries then count as many cosines as two large ones.
    """
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: cosine(a, b))))
    scored = F.sort_array(F.filter(pairs, lambda s: s.isNotNull()), asc=False)
    k = F.least(F.lit(3), *([F.size(left), F.size(right)] if by_size else []), F.size(scored))
    return F.when(F.size(scored) > 0, F.aggregate(F.slice(scored, F.lit(1), k), F.lit(0.0), lambda s, x: s + x) / k)


def tracklet_similarity(base: Column, gallery: Column) -> Column:
    """Descriptor and gallery similarity joined 3 to 7; one alone where the other is missing."""
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), gallery * 0.7 + base * 0.3))
    return F.when(gallery.isNull(), base).when(base.isNull(), gallery).otherwise(both)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
