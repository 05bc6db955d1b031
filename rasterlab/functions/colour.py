"""Colour expressions on 8-bit channel columns."""

from pyspark.sql import Column, functions as F

from rasterlab import params as P


def linear(v: Column) -> Column:
    """sRGB byte to linear light in [0, 1]."""
    s = v / F.lit(255.0)
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def brightness(lr: Column, lg: Column, lb: Column) -> Column:
    """Mean of the three linear channels."""
    return (lr + lg + lb) / 3.0


def ndfi(lr: Column, lg: Column, lb: Column, eps: float = P.EPS) -> Column:
    """Green against the mean of red and blue, in [-1, 1]."""
    rb = (lr + lb) / 2.0
    return (lg - rb) / (lg + rb + eps)


def saturated(r: Column, g: Column, b: Column, level: int = P.SATURATION) -> Column:
    return F.greatest(r, g, b) >= level


def in_roi(x: Column, y: Column, size, center=P.ROI_CENTER, radius: float = P.ROI_RADIUS) -> Column:
    """Inside the circle whose centre and radius are fractions of ``size``."""
    size = size if isinstance(size, Column) else F.lit(size)
    dx, dy = x - size * center[0], y - size * center[1]
    return F.sqrt(dx * dx + dy * dy) <= size * radius


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue on the 0-179 byte scale; 0 for grays."""
    top = F.greatest(r, g, b)
    diff = top - F.least(r, g, b)
    sector = (F.when(top == r, g - b)
              .when(top == g, b - r + 2 * diff)
              .otherwise(r - g + 4 * diff))
    h = F.floor(F.try_divide(sector * 30.0, diff) + 0.5).cast("int")
    return F.when(diff == 0, F.lit(0)).when(h < 0, h + 180).otherwise(h)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation on the 0-255 byte scale; 0 for black."""
    top = F.greatest(r, g, b)
    diff = top - F.least(r, g, b)
    return F.coalesce(F.floor(F.try_divide(diff * 255.0, top) + 0.5).cast("int"), F.lit(0))


def discoloured(r: Column, g: Column, b: Column) -> Column:
    """Dry or tan skin under ordinary light."""
    h = hue(r, g, b)
    lo, hi = P.DISCOLOR_HUE
    return (h >= lo) & (h < hi) & (saturation(r, g, b) >= P.DISCOLOR_SAT_MIN)


def _lab_curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def lab_a(r: Column, g: Column, b: Column) -> Column:
    """CIELAB a* as a byte with offset 128 (D65 white)."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    fx = _lab_curve((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456)
    fy = _lab_curve(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)
    return F.rint((fx - fy) * 500.0 + 128.0)


def oriented(x: Column, y: Column, w: Column, h: Column, orientation: Column):
    """Upright (x, y) of a stored pixel under the eight camera orientations."""
    flip_x, flip_y = w - 1 - x, h - 1 - y
    ox = (F.when(orientation.isin(2, 3), flip_x)
          .when(orientation.isin(5, 8), y)
          .when(orientation.isin(6, 7), flip_y)
          .otherwise(x))
    oy = (F.when(orientation.isin(3, 4), flip_y)
          .when(orientation.isin(5, 6), x)
          .when(orientation.isin(7, 8), flip_x)
          .otherwise(y))
    return ox, oy
