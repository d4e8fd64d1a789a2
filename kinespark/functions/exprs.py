"""Column expressions: casts, units, geometry, scores and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """The number, or null where it is null, not a number or infinite."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def positive(x) -> Column:
    v = finite(x)
    return F.when(v > 0, v)


def ln(x) -> Column:
    """The logarithm; of 0 it is minus infinity."""
    v = _c(x)
    return F.when(v == 0, F.lit(float("-inf"))).otherwise(F.ln(v))


def integral_text(x) -> Column:
    """A number as text, without the fraction if it is whole."""
    v = _c(x)
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def equivalent_diameter(area, width, height) -> Column:
    """Of the circle of that area; without an area, the geometric mean of the box's sides."""
    return F.coalesce(F.sqrt(4 * positive(area) / F.pi()), F.sqrt(positive(width) * positive(height)))


def box_sides(x1, y1, x2, y2, inclusive: bool = True) -> tuple[Column, Column]:
    one = 1 if inclusive else 0
    return _c(x2) - _c(x1) + one, _c(y2) - _c(y1) + one


def box_aspect(width, height) -> Column:
    return F.greatest(F.try_divide(_c(width), _c(height)), F.try_divide(_c(height), _c(width)))


def box_iou(a: list, b: list, inclusive: bool = True) -> Column:
    """Overlap over union of boxes (x1, y1, x2, y2)."""
    one = 1.0 if inclusive else 0.0
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + one)
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + one)
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0] + one) * F.greatest(F.lit(0.0), r[3] - r[1] + one)
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def track_centre(centroid, x, y, box) -> tuple[Column, Column]:
    """For tracks: centroid, else the coordinates, else the box's corner plus half its inclusive side."""
    c, b = _c(centroid), _c(box)
    cx = F.coalesce(F.get(c, F.lit(0)), _c(x), F.get(b, F.lit(0)) + (F.get(b, F.lit(2)) - F.get(b, F.lit(0)) + 1) / 2)
    cy = F.coalesce(F.get(c, F.lit(1)), _c(y), F.get(b, F.lit(1)) + (F.get(b, F.lit(3)) - F.get(b, F.lit(1)) + 1) / 2)
    return cx, cy


def mask_centre(centroid, box) -> tuple[Column, Column]:
    """For masks: centroid, else the mean of the box's corners (half a pixel less than for tracks)."""
    c, b = _c(centroid), _c(box)
    return tuple(F.coalesce(F.get(c, F.lit(i)), (F.get(b, F.lit(i)) + F.get(b, F.lit(i + 2))) / 2) for i in (0, 1))


def relative_error(measured, target, given=None, measured_unit=None, target_unit=None, energy=None) -> Column:
    """For scoring: the given error; else the measurement itself where a unit says it is one; else against the target,
    which is 1 for energy ratios without one."""
    m, t = finite(measured), finite(target)
    if energy is not None:
        t = F.coalesce(t, F.when(_c(energy), F.lit(1.0)))
    plain = F.abs(m - t) / F.greatest(F.abs(t), F.lit(EPS))
    units = [F.lower(_c(u)) == "relative_error" for u in (measured_unit, target_unit) if u is not None]
    out = plain
    for is_error in units:
        out = F.when(F.coalesce(is_error, F.lit(False)), F.abs(m)).otherwise(out)
    return F.coalesce(finite(given), out) if given is not None else out


def estimate_error(measured, target) -> Column:
    """For estimates: against the target's size, or plain where the target is zero."""
    m, t = _c(measured), _c(target)
    return F.abs(m - t) / F.when(F.abs(t) > EPS, F.abs(t)).otherwise(F.lit(1.0))


def base_score(error, tau) -> Column:
    return 100 * F.exp(-_c(error) / _c(tau))


def component_score(value, good, bad, high_is_bad, gamma) -> Column:
    """1 at the good value or better, 0 at the bad one or worse, 1 - progress^gamma between; null where there is no finite
    number."""
    v, g, b = finite(value), _c(good), _c(bad)
    progress = F.when(_c(high_is_bad), (v - g) / (b - g)).otherwise((g - v) / (g - b))
    return F.when(v.isNotNull(), F.lit(1.0) - F.pow(F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0)), _c(gamma)))


def status_from_r2(r2, weak=0.65, valid=0.85) -> Column:
    v = _c(r2)
    return F.when(v.isNull(), "weak_valid").when(v >= valid, "valid").when(v >= weak, "weak_valid").otherwise("invalid")


def reason_from_r2(r2, weak=0.65, valid=0.85) -> Column:
    v = _c(r2)
    return F.when(v.isNull() | (v >= valid), F.lit(None).cast("string")).when(v >= weak, "low_fit_r2").otherwise("fit_failed")


#: Free fall by environment, in m/s^2.
GRAVITY = {"moon": 1.62, "mars": 3.71, "zero": 0.0, "zero_gravity": 0.0}


def gravity(g=None, gravity_=None, reference=None, environment=None, default: float = 9.8) -> Column:
    """The first number given, else by the environment's whole name."""
    given = [finite(x) for x in (g, gravity_, reference) if x is not None]
    name = F.lower(F.coalesce(_c(environment), F.lit(""))) if environment is not None else F.lit("")
    known = F.create_map(*[F.lit(x) for pair in GRAVITY.items() for x in pair])
    return F.coalesce(*given, F.try_element_at(known, name), F.lit(default))


def canonical_id(name) -> Column:
    """Letters and three digits that end a name after its start, a dash or an underscore."""
    return F.nullif(F.regexp_extract(_c(name), r"(?:^|[_-])([A-Z]+\d{3})$", 1), F.lit(""))


def slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(name), r"[^0-9A-Za-z_-]", "_"), r"^_+|_+$", "")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in pairs]))


def clean_json(text) -> Column:
    """JSON text with bare NaN and infinities, which JSON doesn't know, as null."""
    return F.regexp_replace(_c(text), r"(?<=[:\[,\s])(?:NaN|-?Infinity)(?=\s*[,\]}])", "null")
