"""Zero tests and error bounds for a vector field that is linear in a tetrahedron.

Formulas are written once over any values with arithmetic and comparisons; a
small namespace supplies ``where``, ``least``, ``greatest`` and ``abs``, either
as Spark column expressions or as numpy functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class Columns:
    abs = staticmethod(F.abs)

    @staticmethod
    def where(cond, a, b):
        return F.when(cond, a).otherwise(b)

    @staticmethod
    def least(a, b):
        return F.least(a, b)

    @staticmethod
    def greatest(a, b):
        return F.greatest(a, b)

    @staticmethod
    def constant(x, like):
        return F.lit(float(x))

    @staticmethod
    def ratio(a, b):
        return F.try_divide(a, b)


class Arrays:
    abs = staticmethod(np.abs)
    where = staticmethod(np.where)
    least = staticmethod(np.minimum)
    greatest = staticmethod(np.maximum)

    @staticmethod
    def constant(x, like):
        return np.full(np.shape(like), float(x))

    @staticmethod
    def ratio(a, b):
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def face_terms(p):
    """Weights of the zero with respect to the four corner vectors.

    Returns (terms, last): terms[i] holds the three summands of the weight of
    corner i = 0, 1, 2, one per component of the last vector; ``last`` is the
    weight of corner 3. The zero's barycentric coordinates are weight / total.
    """
    sides = ((1, 2), (2, 0), (0, 1))
    normals = [cross(p[a], p[b]) for a, b in sides]
    terms = [tuple(-p[3][c] * n[c] for c in range(3)) for n in normals]
    return terms, dot(p[0], normals[0])


def totals(terms, last):
    """Weights of the four corners and their total."""
    m = [t[0] + t[1] + t[2] for t in terms] + [last]
    return m, m[0] + m[1] + m[2] + m[3]


def within(total, part):
    """part = 0 or total / part > 1, without dividing."""
    return (part == 0) | ((part > 0) & (total > part)) | ((part < 0) & (total < part))


def contains_zero(m, total):
    """The field has a zero in the tetrahedron (total weight must not vanish)."""
    flags = [within(total, x) for x in m]
    return (total != 0) & flags[0] & flags[1] & flags[2] & flags[3]


def sign_margin(ns, parts, fixed):
    """Largest relative change of ``parts`` that keeps the sign of parts + fixed."""
    a, b, c = parts
    none = (a == 0) & (b == 0) & (c == 0)
    spread = ns.abs(a) + ns.abs(b) + ns.abs(c)
    return ns.where(none, ns.constant(1, a), ns.ratio(ns.abs(a + b + c + fixed), spread))


def change_margin(ns, p, terms, last, m, total):
    """Largest relative change of the last corner's vector that neither creates nor
    removes a zero: 0 when there is one, else the best outside face's margin."""
    zero = ns.constant(0, m[0])
    one = ns.constant(1, m[0])
    inside = [within(total, x) for x in m]

    def added(*ts):
        return tuple(sum(t[c] for t in ts[1:]) + ts[0][c] for c in range(3))

    best = zero
    for i in range(3):
        others = [terms[j] for j in range(3) if j != i]
        margin = ns.least(sign_margin(ns, terms[i], 0.0), sign_margin(ns, added(*others), last))
        best = ns.greatest(best, ns.where(inside[i], zero, margin))
    best = ns.greatest(best, ns.where(inside[3], zero, sign_margin(ns, added(*terms), 0.0)))
    one_sided = zero > 1
    for c in range(3):
        v = [q[c] for q in p]
        one_sided = one_sided | ((v[0] > 0) & (v[1] > 0) & (v[2] > 0) & (v[3] > 0))
        one_sided = one_sided | ((v[0] < 0) & (v[1] < 0) & (v[2] < 0) & (v[3] < 0))
    found = inside[0] & inside[1] & inside[2] & inside[3]
    return ns.where(total == 0, ns.where(one_sided, one, zero), ns.where(found, zero, best))
