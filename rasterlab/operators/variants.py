"""Methods for ``ml.evaluate``, generated from axes: estimator x class weight x treatment x cut.

A method's name is the names of its axes' values, joined by `` | ``; plain values are left out.
"""

from collections.abc import Callable, Iterable
from itertools import combinations, product

from pyspark.sql import DataFrame, functions as F

from rasterlab import params as P
from rasterlab.functions import scalar as S
from rasterlab.operators import ml as L

# Tuning grids and sizes.
L2_GRID = [0.01, 0.03, 0.1, 0.3, 1, 3, 10, 30, 100]
L1_GRID = [0.03, 0.1, 0.3, 1, 3, 10, 30]
SVM_GRID = [0.03, 0.1, 0.3, 1, 3, 10]
NEIGHBOUR_GRID = [3, 5, 7, 9, 11, 15]
POSITIVE_WEIGHTS = [0.4, 0.5, 0.6, 0.714, 0.8, 1.4]
FIXED_CUTS = [0.55, 0.6, 0.65]
TREES, BAG_MEMBERS, INNER, INNER_REPEATS = 400, 15, 5, 2

Make = Callable[..., L.Fit]
Wrap = Callable[[L.Fit], L.Fit]

#: estimators that take class weights
WEIGHTED: dict[str, Make] = {
    "forest": lambda w=None: L.forest(TREES, weights=w),
    "forest leaf 2": lambda w=None: L.forest(TREES, 2, weights=w),
    "logistic": lambda w=None: L.logistic(1.0, weights=w),
    "boosting d1": lambda w=None: L.boosting(1, 100, 0.1, weights=w),
    "boosting d2": lambda w=None: L.boosting(2, 100, 0.1, weights=w),
}
#: estimators that take none; the tuned ones search their grid inside the fold
PLAIN: dict[str, Make] = {
    "svm": lambda: L.linear_svm(1.0),
    "naive bayes": lambda: L.gaussian_nb(),
    "nearest": lambda: L.nearest(5),
    "svm tuned": lambda: tuned(L.linear_svm, [(c,) for c in SVM_GRID]),
    "logistic tuned": lambda: tuned(L.logistic, [(c,) for c in L2_GRID]),
    "logistic L1 tuned": lambda: tuned(L.logistic, [(c, True) for c in L1_GRID]),
    "nearest tuned": lambda: tuned(L.nearest, list(product(NEIGHBOUR_GRID, (False, True)))),
}
WEIGHTS: dict[str, object] = {"": None, "balanced": "balanced"} | {f"weight {w:g}": w for w in POSITIVE_WEIGHTS}


def tuned(make: Make, grid: Iterable[tuple], metric: str = "auc") -> L.Fit:
    return L.grid_search([(" ".join(map(str, g)), make(*g)) for g in grid], metric, INNER)


def fixed_cut(at: float) -> Wrap:
    """The same scores, cut at a given value."""
    def wrap(base: L.Fit) -> L.Fit:
        return lambda train, seed: (base(train, seed)[0], at)
    return wrap


def inner_cut(objective: str) -> Wrap:
    return lambda base: L.tuned_threshold(base, objective, repeats=INNER_REPEATS, k=INNER)


TREATMENTS: dict[str, Wrap] = {
    "": lambda base: base,
    **{how: (lambda base, how=how: L.calibrated(base, how, k=INNER)) for how in ("sigmoid", "isotonic")},
    **{f"undersampled x{n}": (lambda base, n=n: L.undersampled(base, n)) for n in (1, BAG_MEMBERS)},
}
CUTS: dict[str, Wrap] = {
    "": lambda base: base,
    **{f"inner {o}": inner_cut(o) for o in ("kappa", "youden")},
    **{f"cut {t:g}": fixed_cut(t) for t in FIXED_CUTS},
    "in-sample kappa": lambda base: L.insample_threshold(base, "kappa"),  # the control: it has seen its rows
}


def _named(parts: Iterable[str], fit: L.Fit) -> L.Method:
    return L.Method(" | ".join(filter(None, parts)), fit)


def crossed(estimators: Iterable[str], weights: Iterable[str] = ("",), treatments: Iterable[str] = ("",),
            cuts: Iterable[str] = ("",)) -> list[L.Method]:
    """Every combination of the named values; estimators without class weights occur once."""
    out = []
    for e in estimators:
        bases = {w: WEIGHTED[e](WEIGHTS[w]) for w in weights} if e in WEIGHTED else {"": PLAIN[e]()}
        out += [_named((e, w, t, c), CUTS[c](TREATMENTS[t](base)))
                for (w, base), t, c in product(bases.items(), treatments, cuts)]
    return out


def votes(estimators: Iterable[str], sizes: Iterable[int] = (2, 3), cuts: Iterable[str] = ("",)) -> list[L.Method]:
    """Soft votes of every two, three, ... of the estimators."""
    fits = {e: (WEIGHTED | PLAIN)[e]() for e in estimators}
    return [_named(("vote " + " + ".join(names), c), CUTS[c](L.vote(*[fits[n] for n in names])))
            for size in sizes for names in combinations(fits, size) for c in cuts]


def classifiers() -> list[L.Method]:
    """Which classifier? Every estimator, and votes."""
    return (crossed(WEIGHTED, ("", "balanced"), cuts=("", "inner kappa")) + crossed(PLAIN)
            + votes(("forest", "logistic", "boosting d1", "svm"), cuts=("", "inner kappa")))


def imbalance(estimator: str = "forest") -> list[L.Method]:
    """How to treat unequal classes: weights and cuts, treatments and cuts, and neither."""
    weighted = crossed([estimator], WEIGHTS, cuts=CUTS)
    return weighted + crossed([estimator], treatments=[t for t in TREATMENTS if t], cuts=CUTS)


def boosting_settings(depths=(1, 2, 3), budgets=(5.0, 10.0), rates=(0.05, 0.1, 0.2)) -> list[L.Method]:
    """Boosting by depth, and by rounds x rate (the budget) at each rate."""
    return [L.Method(f"depth {d} rate {r:g} rounds {round(b / r)}", L.boosting(d, round(b / r), r))
            for d, b, r in product(depths, budgets, rates)]


def finalists(methods: list[L.Method], compared: DataFrame, k: int = 8, by: str = "kappa") -> list[L.Method]:
    """The ``k`` best of ``methods`` in a comparison (name, ``by``), for a re-test on unused seeds; ties by name."""
    best = [r["name"] for r in compared.orderBy(F.col(by).desc_nulls_last(), "name").limit(k).collect()]
    own = {m.name: m for m in methods}
    return [own[n] for n in best if n in own]


def selections(n_features: int, rfe=(5, 8, 10, 12, 15), l1=(0.05, 0.1, 0.5, 1.0)) -> list[L.Method]:
    """How many features, chosen how? All inside the fold."""
    forest = WEIGHTED["forest"]()
    ways = {"top": (range(3, n_features + 1), lambda k: L.selected_topk(forest, k, TREES)),
            "eliminated to": ([k for k in rfe if k < n_features], lambda k: L.selected_rfe(forest, k)),
            "L1": (l1, lambda c: L.selected_l1(forest, c))}
    return [L.Method("all", forest)] + [L.Method(f"{how} {v:g}", make(v)) for how, (values, make) in ways.items() for v in values]


#: row-wise transforms of a list of feature columns
TRANSFORMS: dict[str, Callable[[list[str]], list]] = {
    "": lambda cols: cols,
    "ratio": lambda cols: S.ratio_columns(cols, "brightness_mean"),
    "ratio + reference": lambda cols: S.ratio_columns(cols, "brightness_mean", keep_ref=True),
    "ratio to blue": lambda cols: S.ratio_columns(cols, "mean_B"),
    "log": lambda cols: S.log_columns(cols),
    "row z": lambda cols: S.row_zscores(cols),
    "contrast": lambda cols: [*cols, *S.contrast_columns()],
    "brightness": lambda cols: [*dict.fromkeys([*cols, "brightness_mean"])],
}


def feature_tables(df: DataFrame, selected: list[str], columns: list[str], ids=("id", "y")) -> dict[str, DataFrame]:
    """Every transform of every column set, by name; each is compared under the same methods and folds."""
    sets = {"selected": selected, "all": columns,
            "intensity free": [c for c in columns if c not in P.INTENSITY_FEATURES],
            "intensity only": [c for c in columns if c in P.INTENSITY_FEATURES]}
    return {" | ".join(filter(None, (name, how))): df.select(*ids, *change(cols))
            for (name, cols), (how, change) in product(sets.items(), TRANSFORMS.items())}


def stressed(df: DataFrame, row_id: str, draw: int, pct: float = 0.15) -> DataFrame:
    """The table with one exposure factor per row on its intensity columns."""
    return df.select(*S.perturbed(df.columns, S.exposure_factor(F.col(row_id), draw, pct)))
