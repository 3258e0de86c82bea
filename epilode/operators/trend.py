"""Smooth trends per group with interval estimates of their slope.

For each group a log-link quasi-Poisson smooth of the value over time is fitted
with a penalised cubic regression spline whose penalty also shrinks its null
space.  Candidates are basis sizes 4..k_max; the one whose working residuals
vary least is kept.

Shape of the job: rows are first reduced to sums per group and day, which are
all the fit needs, so a group is never larger than its number of days.  Every
(group, basis size) is fitted as its own small group, so candidates of one site
spread over the cluster, and the choice among them is an ordinary aggregate.
"""

from __future__ import annotations

import re
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.operators.aggregates import median_sd, sample_support
from epilode.operators.joins import null_safe_join
from epilode.session import cut_lineage

# Smallest basis, deviations above the median that make an
# outlier, shrinkage of the penalty's null space.
K_MIN = 4
OUTLIER_SD = 5.0
SHRINK = 0.1


def drop_outliers(df: DataFrame, keys: list[str], value: str, deviations: float = OUTLIER_SD) -> DataFrame:
    """Rows below median + `deviations` sd of their group; missing values go too."""
    stats = median_sd(df, keys, value).select(
        *keys, (F.col("median") + F.lit(deviations) * F.col("sd")).alias("__limit")
    )
    limits = cut_lineage(stats, "outlier_limits")
    return null_safe_join(df, limits, keys).filter(F.col(value) < F.col("__limit")).drop("__limit")


def _curvature(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(second derivatives as a map of knot values, wiggliness penalty)."""
    k, h = len(knots), np.diff(knots)
    d = np.zeros((k - 2, k))
    b = np.zeros((k - 2, k - 2))
    i = np.arange(k - 2)
    d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    b[i, i] = (h[:-1] + h[1:]) / 3
    b[i[:-1], i[1:]] = b[i[1:], i[:-1]] = h[1:-1] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(k), inner, np.zeros(k)]), d.T @ inner


def _basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic regression spline by its knot values, linear outside the knots."""
    second, _ = _curvature(knots)
    inside = np.clip(x, knots[0], knots[-1])
    j = np.clip(np.searchsorted(knots, inside, side="right") - 1, 0, len(knots) - 2)
    h = knots[j + 1] - knots[j]
    lo, hi = (knots[j + 1] - inside) / h, (inside - knots[j]) / h
    eye = np.eye(len(knots))
    rows = (
        lo[:, None] * eye[j]
        + hi[:, None] * eye[j + 1]
        + ((lo**3 - lo) * h**2 / 6)[:, None] * second[j]
        + ((hi**3 - hi) * h**2 / 6)[:, None] * second[j + 1]
    )
    # Beyond the end knots continue along the end slopes.
    for side, end, a, b in ((x < knots[0], 0, 0, 1), (x > knots[-1], -1, -2, -1)):
        if side.any():
            width = knots[b] - knots[a]
            sign = -1 if end == 0 else 1
            slope = (eye[b] - eye[a]) / width + sign * width / 6 * (
                2 * second[end] + second[1 if end == 0 else -2]
            )
            rows[side] = eye[end] + (x[side] - knots[end])[:, None] * slope
    return rows


def _centred(knots: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Map to coefficients of smooths that sum to zero over the rows."""
    sums = (_basis(at, knots) * n[:, None]).sum(axis=0)[:, None]
    return np.linalg.qr(sums, mode="complete")[0][:, 1:]


def _shrunk(penalty: np.ndarray, shrink: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(penalty)
    values[1] = values[2] * shrink
    values[0] = values[1] * shrink
    return vectors @ (values[:, None] * vectors.T)


def _design(knots: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), _basis(x, knots) @ z])


def fit_smooth(x: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray, sl: np.ndarray, k: int) -> dict:
    """Fit one basis size to daily sums.

    Per day: n rows, s = sum(y), ss = sum(y^2), sl = sum(y log y).  The amount
    of smoothing minimises generalised cross-validation.
    """
    span = max(x.max() - x.min(), 1.0)
    u = (x - x.min()) / span
    knots = np.quantile(np.unique(u), np.linspace(0, 1, k))
    z = _centred(knots, u, n)
    design = _design(knots, u, z)
    _, wiggle = _curvature(knots)
    penalty = np.zeros((k, k))
    penalty[1:, 1:] = z.T @ _shrunk(wiggle, SHRINK) @ z
    # Put penalty and data on one scale so that the search range fits both.
    penalty *= (design**2).sum() / max(np.abs(penalty).sum(axis=0).max(), 1e-300)
    total = n.sum()
    start = np.log(np.maximum(s / n, 0) + 0.1)

    def solve(log_weight: float, eta: np.ndarray):
        weight, last = np.exp(log_weight), np.inf
        for _ in range(100):
            mu = np.exp(np.clip(eta, -700, 700))
            work = eta + (s / n - mu) / mu
            xw = design * (n * mu)[:, None]
            info = xw.T @ design
            beta = np.linalg.lstsq(info + weight * penalty, xw.T @ work, rcond=None)[0]
            eta = design @ beta
            mu = np.exp(np.clip(eta, -700, 700))
            dev = 2 * (sl.sum() - (s * eta).sum() - s.sum() + (n * mu).sum())
            target = dev + weight * beta @ penalty @ beta
            if abs(last - target) < 1e-9 * (abs(target) + 0.1):
                break
            last = target
        info = (design * (n * mu)[:, None]).T @ design
        cover = np.linalg.pinv(info + weight * penalty)
        edf = float(np.trace(cover @ info))
        gcv = total * max(dev, 0.0) / max(total - edf, 1e-9) ** 2
        return gcv, beta, eta, cover, edf, mu

    grid = np.linspace(-20, 20, 21)
    scores, eta = [], start
    for g in grid[::-1]:
        got = solve(g, eta)
        eta = got[2]
        scores.append(got[0])
    best = int(np.argmin(scores))
    lo, hi = grid[::-1][best] - 2, grid[::-1][best] + 2
    golden = (np.sqrt(5) - 1) / 2
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fa, fb = solve(a, eta)[0], solve(b, eta)[0]
    for _ in range(20):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - golden * (hi - lo)
            fa = solve(a, eta)[0]
        else:
            lo, a, fa = a, b, fb
            b = lo + golden * (hi - lo)
            fb = solve(b, eta)[0]
    _, beta, _, cover, edf, mu = solve((lo + hi) / 2, eta)
    pearson = ((ss - 2 * mu * s + n * mu**2) / mu).sum()
    scale = pearson / max(total - edf, 1e-9)
    mean = ((s - n * mu) / mu).sum() / total
    squares = ((ss - 2 * mu * s + n * mu**2) / mu**2).sum()
    spread = np.sqrt(max(squares - total * mean**2, 0.0) / max(total - 1, 1))
    return {
        "k": k, "resid_sd": float(spread), "edf": edf, "scale": float(scale),
        "origin": float(x.min()), "span": float(span), "knots": knots.tolist(), "coef": beta.tolist(),
        "centring": z.ravel().tolist(), "covariance": (cover * scale).ravel().tolist(),
    }


# Tasks that share a group's basis sizes.
_PARTS = 8

_MODEL = (
    "k int, resid_sd double, edf double, scale double, origin double, span double, "
    "knots array<double>, coef array<double>, centring array<double>, covariance array<double>"
)


def _smooth_at(model: pd.Series, days: np.ndarray) -> np.ndarray:
    knots = np.asarray(model["knots"], dtype=float)
    z = np.asarray(model["centring"], dtype=float).reshape(len(knots), -1)
    return _design(knots, (days - model["origin"]) / model["span"], z)


def trend_support(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Usable samples, largest basis and `status` (`ok` or `insufficient`) per group."""
    return sample_support(df, keys, date, value).withColumn(
        "status", F.when(F.col("k_max") < K_MIN, F.lit("insufficient")).otherwise(F.lit("ok"))
    )


def _types(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _sums(pdf: pd.DataFrame) -> list[np.ndarray]:
    pdf = pdf.sort_values("day")
    return [pdf[c].to_numpy(dtype=float) for c in ("day", "n", "s", "ss", "sl")]


def choose_model(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The basis size whose working residuals vary least per group, the smaller one on a tie.

    candidates(*keys, k, resid_sd).
    """
    best = F.min_by("k", F.struct(F.round("resid_sd", 12), "k"))
    return candidates.groupBy(*keys).agg(best.alias("k"))


def fit_trends(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Chosen model per group: one row with its coefficients and a `status`.

    Every group has a row.  `ok` rows hold a model; `insufficient` groups have too few
    usable samples, and those `without enough days` too few days once outliers are gone.
    Candidates only return their score; the chosen one is fitted again.  A group's sizes
    are dealt into `_PARTS` parts at most, each of which gets the days once.
    """
    support = cut_lineage(trend_support(df, keys, date, value), "trend_support")
    v = F.col(value).cast("double")
    daily = cut_lineage(
        drop_outliers(df, keys, value)
        .groupBy(*keys, F.datediff(date, F.lit("1970-01-01")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
            F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("sl"),
        ),
        "daily_sums",
    )
    enough = support.filter("status = 'ok'")
    last = F.least(F.col("k_max") - K_MIN, F.lit(_PARTS - 1))
    parts = enough.select(*keys, "k_max", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    cols = _types(df, keys)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = _sums(pdf)
        # Every so many sizes from the part's own on, so that parts are alike.
        sizes = [k for k in range(K_MIN + int(pdf["part"].iloc[0]), int(pdf["k_max"].iloc[0]) + 1, _PARTS) if k <= len(pdf)]
        scores = [fit_smooth(*sums, k)["resid_sd"] for k in sizes]
        heads = pd.concat([pdf[keys].head(1)] * len(sizes), ignore_index=True) if sizes else pdf[keys].head(0)
        return heads.assign(k=sizes, resid_sd=scores)

    candidates = null_safe_join(daily, parts, keys, "inner").groupBy(*keys, "part").applyInPandas(
        score, f"{cols}, k int, resid_sd double"
    )
    chosen = cut_lineage(choose_model(candidates, keys), "chosen_sizes")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {key: pdf[key].iloc[0] for key in keys}
        return pd.DataFrame([{**row, **fit_smooth(*_sums(pdf), int(pdf["k"].iloc[0]))}])

    models = null_safe_join(daily, chosen, keys, "inner").groupBy(*keys).applyInPandas(fit, f"{cols}, {_MODEL}")
    status = F.when((F.col("status") == "ok") & F.col("k").isNull(), F.lit("without enough days")).otherwise(F.col("status"))
    return null_safe_join(support.select(*keys, "status"), models, keys).withColumn("status", status)


def trend_curve(df: DataFrame, keys: list[str], date: str, value: str, conf_level: float = 0.95,
                models: DataFrame | None = None) -> DataFrame:
    """Prediction, one-day slope of the log trend and its interval on sample days.

    A group without a model comes back as one row without a day, whose `status` says why.
    Each model meets its group's days once.
    """
    models = cut_lineage(fit_trends(df, keys, date, value), "trend_models") if models is None else models
    days = df.select(*keys, F.col(date).cast("date").alias("__date")).distinct()
    numbers = ["pred", "fst_deriv", "fst_deriv_ul", "fst_deriv_ll"]
    schema = f"{_types(df, keys)}, `{date}` date, {', '.join(f'{n} double' for n in numbers)}, status string"
    width = NormalDist().inv_cdf(1 - (1 - conf_level) / 2)

    def predict(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if found.empty:
            return pd.DataFrame(columns=[*keys, date, *numbers, "status"])
        model = found.iloc[0]
        if model["status"] != "ok":
            return found[keys].head(1).assign(**{date: None, **dict.fromkeys(numbers, np.nan), "status": model["status"]})
        day = (pd.to_datetime(pdf["__date"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(dtype=float)
        now, after = _smooth_at(model, day), _smooth_at(model, day + 1)
        coef = np.asarray(model["coef"], dtype=float)
        cover = np.asarray(model["covariance"], dtype=float).reshape(len(coef), -1)
        step = after - now
        slope = step @ coef
        se = np.sqrt(np.maximum(((step @ cover) * step).sum(axis=1), 0.0))
        out = pdf[keys].copy()
        out[date] = pdf["__date"]
        out["pred"] = np.exp(now @ coef)
        out["fst_deriv"], out["fst_deriv_ul"], out["fst_deriv_ll"] = slope, slope + width * se, slope - width * se
        out["status"] = "ok"
        return out

    curves = days.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(predict, schema)
    return curves.replace(float("nan"), None, subset=numbers)


def trend_column_names(target: str) -> dict[str, str]:
    """Output column names for a target: `<x>_pred`, `<prefix>fst_deriv`, `_ul`, `_ll`."""
    # Fixed value: the part of a target's name that prefixes its slope columns.
    found = re.search(r"^(rsv_)|(.+_(a|b|cov2)_)", target)
    prefix = found.group(0) if found else ""
    return {
        "pred": f"{target}_pred", "fst_deriv": f"{prefix}fst_deriv",
        "fst_deriv_ul": f"{prefix}fst_deriv_ul", "fst_deriv_ll": f"{prefix}fst_deriv_ll",
    }


def wide_trends(curves: DataFrame, keys: list[str], date: str, target: str, targets: list[str]) -> DataFrame:
    """One column set per target, named as in `trend_column_names`."""
    aggs = [
        F.max(F.when(F.col(target) == t, F.col(c))).alias(name)
        for t in targets
        for c, name in trend_column_names(t).items()
    ]
    return curves.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(*aggs)
