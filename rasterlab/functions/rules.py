"""Decision rules on scored scans: labels, advice, trust, validation."""

from pyspark.sql import Column, functions as F

from rasterlab import params as P


def predicted_label(proba: Column, threshold: Column) -> Column:
    return (proba >= threshold).cast("int")


def confidence(proba: Column, threshold: Column) -> Column:
    return F.when(proba >= threshold, proba).otherwise(1 - proba)


def borderline(proba: Column, threshold: Column) -> Column:
    """Leans positive yet reads negative."""
    return (proba >= 0.5) & (proba < threshold)


def agreement(truth: Column, label: Column) -> Column:
    """NULL unless both are known."""
    return truth == label


def unreliable_reason(ood: Column, framing_ok: Column, scale: Column, background: Column) -> Column:
    """First reason, in order of precedence, why a label cannot be trusted."""
    return (F.when(ood == "out_of_range", "out_of_range")
            .when(~framing_ok, "framing")
            .when(scale == "inconsistent", "scale")
            .when(background == "inconsistent", "background"))


def advice_level(label: Column, is_borderline: Column, reason: Column) -> Column:
    return (F.when(reason.isNotNull(), "unreliable")
            .when(label == 1, "positive")
            .when(is_borderline, "caution")
            .when(label == 0, "negative"))


def trust_flags(ood: Column, is_borderline: Column, framing_ok: Column) -> Column:
    return F.array_compact(F.array(
        F.when(ood == "out_of_range", "out_of_range"),
        F.when(is_borderline, "borderline"),
        F.when(~framing_ok, "framing")))


def framing_warnings(ok: Column, touches: Column, padded: Column, black_share: Column,
                     limit: float = P.PAD_WARN_FRAC) -> Column:
    return F.array_compact(F.array(
        F.when(~ok, "not_found"),
        F.when(F.size(touches) > 0, F.concat(F.lit("touches:"), F.concat_ws(",", touches))),
        F.when(padded & (black_share > limit), "padded")))


def failed_views(captures: Column) -> Column:
    """Steps whose framing failed; an unknown outcome counts as fine."""
    return F.transform(F.filter(captures, lambda c: ~F.coalesce(c["ok"], F.lit(True))),
                       lambda c: c["step_id"])


def views_used(captures: Column) -> Column:
    return F.size(F.filter(captures, lambda c: c["kind"] == "uv"))


def drop_reason(code: Column, truth: Column, framing_ok: Column, features: Column,
                required: list[str], excluded: Column | None = None,
                require_framing: bool = False) -> Column:
    """Why a scan cannot be a training row; NULL when it can."""
    missing = F.size(F.array_except(F.array(*[F.lit(f) for f in required]),
                                    F.coalesce(F.map_keys(features), F.array().cast("array<string>"))))
    out = F.when(excluded if excluded is not None else F.lit(False), F.lit("excluded"))
    out = out.when(truth.isNull(), "no_lab_result")
    if require_framing:
        out = out.when(~framing_ok, "framing_failed")
    return out.when(missing > 0, F.concat(F.lit("missing_"), missing.cast("string")))


def code_problem(code: Column, crop: Column, dataset: Column) -> Column:
    """Why an upload's code or crop is refused; NULL when it is accepted."""
    trimmed = F.trim(F.coalesce(code, F.lit("")))
    return (F.when(~F.coalesce(crop, F.lit("onion")).isin(P.CROPS), "bad_crop")
            .when((dataset == "research") & (trimmed == ""), "code_required")
            .when(F.length(trimmed) > P.CODE_MAX_CHARS, "code_too_long"))


def domain_problems(label: Column, truth: Column, conf: Column, proba: Column, crop: Column) -> Column:
    """Names of the columns outside their allowed values; NULL values pass."""
    return F.array_compact(F.array(
        F.when(~label.isin(0, 1), "pred_label"),
        F.when(~truth.isin(0, 1), "compactdry_truth"),
        F.when(~conf.between(0.0, 1.0), "pred_conf"),
        F.when(~proba.between(0.0, 1.0), "pred_proba"),
        F.when(~crop.isin(P.CROPS), "crop")))


def search_match(code: Column, text: str) -> Column:
    """Case-insensitive substring; blank text matches all."""
    text = text.strip().lower()
    return F.contains(F.lower(code), F.lit(text)) if text else F.lit(True)


def history_filter(code: Column, label: Column, flags: Column, text="", want_label="all", want_flag="all"):
    cond = search_match(code, text)
    if want_label != "all":
        cond = cond & (F.coalesce(label.cast("string"), F.lit("na")) == want_label)
    if want_flag != "all":
        cond = cond & (F.when(F.size(flags) > 0, "flagged").otherwise("ok") == want_flag)
    return cond


def sample_filter(code: Column, truth: Column, agree: Column, text="", want_truth="all", want_agree="all"):
    """``na`` is the bucket of rows without a reference result."""
    cond = search_match(code, text)
    if want_truth != "all":
        cond = cond & (F.coalesce(truth.cast("string"), F.lit("na")) == want_truth)
    if want_agree != "all":
        state = F.when(agree, "yes").when(~agree, "no").otherwise("na")
        cond = cond & (state == want_agree)
    return cond


def queue_filter(code: Column, crop: Column, truth: Column, text="", want_crop="", mode="all"):
    cond = search_match(code, text)
    if want_crop:
        cond = cond & (F.coalesce(crop, F.lit("onion")) == want_crop)
    known = F.coalesce(truth.isin(0, 1), F.lit(False))
    if mode == "pending":
        cond = cond & ~known
    elif mode == "done":
        cond = cond & known
    return cond


def clamped_limit(value) -> int:
    """Requested list length: default 200, at most 500; 0 or less means all."""
    try:
        return min(int(value), P.LIST_LIMIT_MAX)
    except (TypeError, ValueError):
        return P.LIST_LIMIT_DEFAULT
