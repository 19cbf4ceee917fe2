"""Tolerances and closed ranges as column expressions.

Ranges are closed at both ends; an unrestricted range has infinite bounds, so a predicate stays a plain
BETWEEN. Widths are given as positive numbers on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mass difference of neighbouring isotopes.
NEUTRON = 1.0033548378
INF = float("inf")


@dataclass(frozen=True)
class Width:
    """A two-sided width: kind is absolute, ppm, percent, minutes or unrestricted."""

    kind: str
    lo: float = 0.0
    hi: float = 0.0

    def around(self, x: Column) -> tuple[Column, Column]:
        if self.kind == "unrestricted":
            return F.lit(-INF), F.lit(INF)
        if self.kind in ("absolute", "minutes"):
            return x - self.lo, x + self.hi
        scale = 1e6 if self.kind == "ppm" else 100.0
        return x * (1 - self.lo / scale), x * (1 + self.hi / scale)


def around_by(x: Column, kind: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """As Width.around, with a width per row."""
    scale = F.when(kind == "ppm", 1e6).otherwise(100.0)
    whole = kind.isin("absolute", "minutes")
    open_ = lambda c, end: F.when(kind == "unrestricted", end).otherwise(c)
    return open_(F.when(whole, x - lo).otherwise(x * (1 - lo / scale)), -INF), open_(F.when(whole, x + hi).otherwise(x * (1 + hi / scale)), INF)


@dataclass(frozen=True)
class Tolerance:
    """Widths of the four dimensions of a query, with the usual defaults."""

    ms: Width = Width("ppm", 20, 20)
    rt: Width = Width("unrestricted")
    mobility: Width = Width("percent", 3, 3)
    quad: Width = Width("absolute", 0.1, 0.1)

    def with_rt(self, rt: Width) -> Tolerance:
        return replace(self, rt=rt)

    def with_mobility(self, mobility: Width) -> Tolerance:
        return replace(self, mobility=mobility)

    def widened_mobility(self, factor: float) -> Tolerance:
        m = self.mobility
        return replace(self, mobility=Width(m.kind, m.lo * factor, m.hi * factor))


def spectral_tolerance(mz_ppm: tuple[float, float], mobility_pct: tuple[float, float]) -> Tolerance:
    """For the second look at an apex: half a second of retention, calibrated mass and mobility."""
    return Tolerance(Width("ppm", *mz_ppm), Width("minutes", 0.5 / 60, 0.5 / 60), Width("percent", *mobility_pct), Width("absolute", 0.1, 0.1))


def isotope_tolerance(mz_ppm: tuple[float, float], mobility_pct: tuple[float, float]) -> Tolerance:
    return spectral_tolerance(mz_ppm, mobility_pct).with_mobility(Width("percent", 3, 3))


# Names under which each kind may stand in a tolerance file.
KINDS = {
    "ms": {"Absolute": "absolute", "da": "absolute", "Ppm": "ppm", "ppm": "ppm"},
    "rt": {"Minutes": "minutes", "minutes": "minutes", "Pct": "percent", "percent": "percent", "Unrestricted": "unrestricted"},
    "mobility": {"Absolute": "absolute", "absolute": "absolute", "Pct": "percent", "percent": "percent", "pct": "percent", "Unrestricted": "unrestricted"},
    "quad": {"Absolute": "absolute", "absolute": "absolute", "da": "absolute"},
}


def tolerance_from_json(o: dict) -> Tolerance:
    """A tolerance object; unknown keys and negative widths are errors."""
    unknown = set(o) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    got = {}
    for dim, v in o.items():
        kind, widths = (v, (0, 0)) if isinstance(v, str) else next(iter(v.items()))
        if kind not in KINDS[dim]:
            raise ValueError(f"{dim}: unknown kind {kind}")
        lo, hi = widths
        if lo < 0 or hi < 0:
            raise ValueError(f"{dim}: widths must not be negative")
        got[dim] = Width(KINDS[dim][kind], lo, hi)
    return Tolerance(**got)


def rt_range_ms(rt_seconds: Column, w: Width) -> tuple[Column, Column]:
    """Retention bounds in whole milliseconds, cut off and never below 0; open bounds are null."""
    if w.kind == "unrestricted":
        return F.lit(None).cast("long"), F.lit(None).cast("long")
    minutes = rt_seconds / 60.0
    lo, hi = w.around(minutes)
    whole = lambda c: F.greatest(F.lit(0), F.floor(c * 60_000.0).cast("long"))
    return whole(lo), whole(hi)


def overlaps(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def encloses(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= lo2) & (hi2 <= hi1)


def isotope_mz(mono: Column, isotope: Column, charge: Column) -> Column:
    return mono + isotope * NEUTRON / charge


def quad_range(mono: Column, charge: Column, isotopes: Column, w: Width) -> tuple[Column, Column]:
    """Isolation range of a precursor: its non-negative isotopes widened by an absolute width."""
    kept = F.filter(isotopes, lambda i: i >= 0)
    return isotope_mz(mono, F.array_min(kept), charge) - w.lo, isotope_mz(mono, F.array_max(kept), charge) + w.hi


def window_overlaps(mz_lo: Column, mz_hi: Column, im_lo: Column, im_hi: Column, s: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(hit, mobility from, mobility to) of a query box against an isolation shape.

    A shape is a band between two mobilities whose m/z edges run straight from one end to the other (equal
    ends make a box). The box hits if at some mobility both ranges share an m/z; the shape's edges are
    linear, so it is enough to look at where they cross the box's sides."""
    a, b = F.greatest(im_lo, s["im0"]), F.least(im_hi, s["im1"])
    span = s["im1"] - s["im0"]
    at = lambda e0, e1, im: F.when((span == 0) | (e0 == e1), e0).otherwise(e0 + (e1 - e0) * (im - s["im0"]) / span)

    def cut(e0: Column, e1: Column, level: Column, below: bool) -> tuple[Column, Column]:
        """Mobilities between a and b at which the edge is at most (or at least) ``level``."""
        va, vb = at(e0, e1, a), at(e0, e1, b)
        cross = F.when(vb == va, a).otherwise(a + (b - a) * (level - va) / (vb - va))
        ok_a, ok_b = (va <= level, vb <= level) if below else (va >= level, vb >= level)
        return F.when(ok_a, a).when(ok_b, cross).otherwise(F.lit(INF)), F.when(ok_b, b).when(ok_a, cross).otherwise(F.lit(-INF))

    lo1, hi1 = cut(s["mz_lo0"], s["mz_lo1"], mz_hi, True)
    lo2, hi2 = cut(s["mz_hi0"], s["mz_hi1"], mz_lo, False)
    lo, hi = F.greatest(lo1, lo2), F.least(hi1, hi2)
    return (a <= b) & (lo <= hi), lo, hi
