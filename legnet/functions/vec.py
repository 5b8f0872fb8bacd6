"""Vectors struct<x,y,z> and symmetric matrices struct<xx,yy,zz,xy,zx,yz>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
PARTS = ("xx", "yy", "zz", "xy", "zx", "yz")


def vec(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def cov(xx, yy, zz, xy=None, zx=None, yz=None) -> Column:
    zero = F.lit(0.0)
    parts = (xx, yy, zz, xy, zx, yz)
    return F.struct(
        *[(zero if p is None else p).alias(n) for n, p in zip(PARTS, parts)]
    )


def _zip(a: Column, b: Column, names, op) -> Column:
    return F.struct(*[op(a[n], b[n]).alias(n) for n in names])


def vadd(a: Column, b: Column) -> Column:
    return _zip(a, b, AXES, lambda p, q: p + q)


def vsub(a: Column, b: Column) -> Column:
    return _zip(a, b, AXES, lambda p, q: p - q)


def vscale(a: Column, k) -> Column:
    return F.struct(*[(a[n] * k).alias(n) for n in AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sadd(a: Column, b: Column) -> Column:
    return _zip(a, b, PARTS, lambda p, q: p + q)


def ssub(a: Column, b: Column) -> Column:
    return _zip(a, b, PARTS, lambda p, q: p - q)


def sscale(a: Column, k) -> Column:
    return F.struct(*[(a[n] * k).alias(n) for n in PARTS])


# Row i, column j of the symmetric matrix is stored under this part name.
_CELL = (("xx", "xy", "zx"), ("xy", "yy", "yz"), ("zx", "yz", "zz"))


def smul_vec(s: Column, d: Column) -> Column:
    """Matrix times vector."""
    rows = []
    for i in range(3):
        total = s[_CELL[i][0]] * d["x"]
        for j in (1, 2):
            total = total + s[_CELL[i][j]] * d[AXES[j]]
        rows.append(total)
    return vec(*rows)


def smul(a: Column, b: Column) -> Column:
    """Product of two symmetric matrices, as struct of nine cells m11..m33."""
    cells = []
    for i in range(3):
        for j in range(3):
            total = a[_CELL[i][0]] * b[_CELL[0][j]]
            for k in (1, 2):
                total = total + a[_CELL[i][k]] * b[_CELL[k][j]]
            cells.append(total.alias(f"m{i + 1}{j + 1}"))
    return F.struct(*cells)


def sdet(s: Column) -> Column:
    return (
        s["xx"] * (s["yy"] * s["zz"] - s["yz"] * s["yz"])
        - s["xy"] * (s["xy"] * s["zz"] - s["yz"] * s["zx"])
        + s["zx"] * (s["xy"] * s["yz"] - s["yy"] * s["zx"])
    )


def sinv(s: Column) -> Column:
    """Inverse by adjugate over determinant; NULL when the determinant is 0."""
    det = sdet(s)
    inv = cov(
        (s["yy"] * s["zz"] - s["yz"] * s["yz"]) / det,
        (s["xx"] * s["zz"] - s["zx"] * s["zx"]) / det,
        (s["xx"] * s["yy"] - s["xy"] * s["xy"]) / det,
        (s["zx"] * s["yz"] - s["xy"] * s["zz"]) / det,
        (s["xy"] * s["yz"] - s["yy"] * s["zx"]) / det,
        (s["xy"] * s["zx"] - s["xx"] * s["yz"]) / det,
    )
    return F.when(det != 0.0, inv)


def ssolve(s: Column, d: Column) -> Column:
    """The vector e with s * e = d."""
    return smul_vec(sinv(s), d)


def is_exact(s: Column) -> Column:
    cond = s[PARTS[0]] == 0.0
    for n in PARTS[1:]:
        cond = cond & (s[n] == 0.0)
    return cond


def sum_struct(col, names) -> list[Column]:
    """One sum aggregate per struct part, aliased to the part name."""
    return [F.sum(F.col(f"{col}.{n}")).alias(f"{col}_{n}") for n in names]
