"""Small scalar expressions shared by the operators."""

import math

from pyspark.sql import Column, functions as F

from rasterlab import params as P


def to_double(c: Column, default: float = 0.0) -> Column:
    """Text to double; anything that does not parse becomes ``default``."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def feature_map(c: Column) -> Column:
    """JSON text to an open name -> value map."""
    return F.from_json(c, "map<string,double>")


def circle_radius(area: Column) -> Column:
    """Radius of the circle with the same area."""
    return F.sqrt(area / F.lit(math.pi))


def small_share(n_small: Column, n_large: Column) -> Column:
    return n_small / (n_small + n_large + P.EPS)


def setting_text(raw: Column) -> Column:
    """Camera setting as decimal text: ``a/b`` is divided, the rest is kept."""
    parts = F.split(raw, "/")
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"),
                         F.get(parts, F.lit(1)).try_cast("double"))
    return F.when(F.size(parts) == 2, F.coalesce(ratio.cast("string"), raw)).otherwise(raw)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def uploadable(path: Column) -> Column:
    return extension(path).isin(P.UPLOAD_EXTENSIONS)


# How a camera writes the orientation of a photo (tag 0x0112, one short) in either byte order.
_TAG_HEADER = "(?:457869660000|65584966)"
_ORIENTATION_BIG = "4D4D002A(?:..){4,4000}?011200030000000100(0[1-8])"
_ORIENTATION_LITTLE = "49492A00(?:..){4,4000}?1201030001000000(0[1-8])00"
TAG_BYTES = 65_536


def exif_orientation(content: Column) -> Column:
    """Orientation 1 to 8 from the first bytes of a JPEG or PNG file; 1 where there is none."""
    head = F.hex(F.substring(content, 1, TAG_BYTES))
    pattern = f"^(?:..)*?{_TAG_HEADER}(?:{_ORIENTATION_BIG}|{_ORIENTATION_LITTLE})"
    found = F.concat(F.regexp_extract(head, pattern, 1), F.regexp_extract(head, pattern, 2))
    return F.coalesce(found.try_cast("int"), F.lit(1))


def base_feature(name: Column) -> Column:
    """Feature name without its view suffix."""
    return F.regexp_replace(name, "_viewmean|_viewmax", "")


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounding the exact binary value half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def span_text(value: Column, span: Column) -> Column:
    """Fixed-point text with more digits the tighter the range is."""
    return (F.when(span >= 0.05, fixed(value, 2)).when(span >= 0.005, fixed(value, 3)).otherwise(fixed(value, 4)))


def balance_band(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "good").when(ratio >= 0.5, "fair").otherwise("poor")


def severity_group(truth: Column, severity: Column, hard_negative: Column) -> Column:
    return (F.when(truth == 1, F.concat(F.lit("positive_"), severity))
            .when(hard_negative, "negative_hard").otherwise("negative_clean"))


def generated_code(captured_at: Column, id_: Column) -> Column:
    """``P`` + date + six hex digits for scans that carry no code."""
    return F.concat(F.lit("P"), F.date_format(captured_at, "yyMMdd"), F.lit("-"),
                    F.substring(F.md5(id_.cast("string")), 1, 6))


# --- row-wise feature transforms ------------------------------------------

def ratio_columns(cols: list[str], ref: str, keep_ref: bool = False) -> list[Column]:
    """Intensity columns over the row's own reference; the rest unchanged."""
    out = []
    for c in cols:
        if c == ref:
            if keep_ref:
                out.append(F.col(c))
        elif c in P.INTENSITY_FEATURES:
            out.append((F.col(c) / F.greatest(F.col(ref), F.lit(1e-9))).alias(f"{c}/{ref}"))
        else:
            out.append(F.col(c))
    if keep_ref and ref not in cols:
        out.append(F.col(ref))
    return out


def log_columns(cols: list[str], heavy=tuple(P.HEAVY_TAILED_FEATURES)) -> list[Column]:
    return [F.log1p(F.col(c)).alias(f"log1p({c})") if c in heavy else F.col(c) for c in cols]


def row_zscores(cols: list[str], block=tuple(P.COLOUR_FEATURES)) -> list[Column]:
    """The colour block against the row's own mean and population SD."""
    vals = [F.col(c) for c in block]
    mean = sum(vals[1:], vals[0]) / len(vals)
    sq = [(v - mean) * (v - mean) for v in vals]
    sd = F.greatest(F.sqrt(sum(sq[1:], sq[0]) / len(vals)), F.lit(1e-12))
    return [((F.col(c) - mean) / sd).alias(f"z_{c}") if c in block else F.col(c) for c in cols]


def contrast_columns() -> list[Column]:
    pairs = [("sd_B", "mean_B", "sd_B/mean_B"), ("sd_G", "mean_G", "sd_G/mean_G"),
             ("mean_G", "mean_B", "mean_G/mean_B"), ("texture", "brightness_mean", "texture/brightness")]
    return [(F.col(a) / F.greatest(F.col(b), F.lit(1e-9))).alias(n) for a, b, n in pairs]


def exposure_factor(row_id: Column, draw, pct: float = 0.15) -> Column:
    """One factor per row and draw in [1-pct, 1+pct)."""
    from rasterlab.functions.hashing import uniform
    return uniform(F.lit(draw), row_id) * (2 * pct) + (1 - pct)


def perturbed(cols: list[str], factor: Column, intensity=tuple(P.INTENSITY_FEATURES)) -> list[Column]:
    return [(F.col(c) * factor).alias(c) if c in intensity else F.col(c) for c in cols]


def pass_marks(values: dict[str, Column], bar=P.PASS_BAR) -> Column:
    """``metric+`` or ``metric-`` for each metric with a bar."""
    return F.concat_ws(" ", *[
        F.concat(F.lit(k), F.when(values[k] >= v, "+").otherwise("-")) for k, v in bar.items()])


def passes(values: dict[str, Column], bar=P.PASS_BAR) -> Column:
    conds = [values[k] >= v for k, v in bar.items()]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
