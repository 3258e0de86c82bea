import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.operators import trend as T
from epilode.plans.wastewater import normalise_sites, prepare

SITES = [s for _, _, s in V.PLANTS]
D0 = dt.date(2023, 3, 1)
SCHEMA = "short_name string, sample_collect_date date, sample_collect_time string, v double, m double, f double, ordinal int"


def run(spark, samples):
    rows = [(s, D0 + dt.timedelta(days=d), t, v, m, 2.0, i) for i, (s, d, t, v, m) in enumerate(samples)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = normalise_sites(df, {"x": "v"}, marker="m", flow="f")
    return {(r["short_name"], (r["sample_collect_date"] - D0).days): r for r in out.collect()}


def day(d, *, skip=(), v=1.0, m=1.0):
    return [(s, d, "08:00", v, m) for s in SITES if s not in skip]


def test_complete_days_stay(spark):
    got = run(spark, day(0))
    assert len(got) == 8 and got[("egan", 0)]["x_flow_pmmov_norm_site"] == 2.0


def test_late_sample_moves_back(spark):
    got = run(spark, [*day(0, skip=["lemont"]), ("lemont", 1, "09:00", 7.0, 1.0)])
    assert len(got) == 8 and got[("lemont", 0)]["v"] == 7.0


def test_overfull_day_is_dropped(spark):
    assert run(spark, [*day(0), ("lemont", 1, "09:00", 7.0, 1.0)]) == {}


def test_six_others_and_two_late_samples_pass(spark):
    # Another day's rule moves nothing here: eight rows, though one site is missing.
    got = run(spark, [*day(0, skip=["lemont", "egan"]), ("egan", 0, "1", 1.0, 1.0), ("lemont", 1, "1", 5.0, 1.0)])
    assert len(got) == 8


def test_earliest_sample_wins(spark):
    got = run(spark, [("egan", 0, None, 9.0, 1.0), ("egan", 0, "11:00", 8.0, 1.0), ("egan", 0, "07:00", 5.0, 1.0), *day(0, skip=["egan"])])
    # Ten raw rows: nine are not the late site, so nothing moves.
    assert got[("egan", 0)]["v"] == 5.0


def test_missing_marker_voids_the_site(spark):
    got = run(spark, [*day(0, skip=["egan"]), ("egan", 0, "1", 1.0, None), *day(2)])
    assert {k: r["x_flow_pmmov_norm_site"] is None for k, r in got.items() if k[0] == "egan"} == {("egan", 0): True, ("egan", 2): True}
    assert got[("kirie", 2)]["x_flow_pmmov_norm_site"] == 2.0


def test_two_full_days_in_a_row_lose_both(spark):
    # The late site's second sample moves although it sampled the day before.
    assert run(spark, [*day(0), *day(1)]) == {}


def test_unknown_site_voids_the_late_rule(spark):
    got = run(spark, [*day(0, skip=["lemont"]), (None, 0, "1", 1.0, 1.0), ("lemont", 1, "1", 5.0, 1.0)])
    assert (None, 0) in got and ("lemont", 0) not in got


def test_prepare_from_raw(spark):
    plants = ["James C. KIRIE WRP", "John E. Egan", "Hanover Park", "Terrence O'Brien", "Stickney SWS", "Stickney WS", "Lemont", "Calumet"]
    cols = "inf_a_copies_l_wastewater inf_b_copies_l_wastewater pcr_target_avg_conc rsv_copies_l_wastewater pmmov_copies_l_wastewater".split()
    rows = [("17031", "wwtp", p, D0, "1", 3.0, 1.0, 2.0, 3.0, 4.0, 5.0, i) for i, p in enumerate(plants)]
    rows.append(("17043", "wwtp", "Elsewhere", D0, "1", 3.0, 1.0, 2.0, 3.0, 4.0, 5.0, 99))
    schema = ("county_names string, sample_location string, wwtp_name string, sample_collect_date date, sample_collect_time string, "
              "flow_rate double, " + ", ".join(f"{c} double" for c in cols) + ", ordinal int")
    out = prepare(spark.createDataFrame(rows, schema)).collect()
    assert {r["short_name"] for r in out} == set(SITES)
    assert {(r["flu_a_flow_pmmov_norm_site"], r["rsv_flow_pmmov_norm_site"]) for r in out} == {(3.0, 12.0)}


# ---- trends ------------------------------------------------------------------


def series(spark, groups):
    rows = [(g, D0 + dt.timedelta(days=d), v) for g, pts in groups.items() for d, v in pts]
    return spark.createDataFrame(rows, "site string, day date, value double")


def test_log_linear_growth(spark):
    df = series(spark, {"a": [(2 * i, math.exp(1 + 0.03 * 2 * i)) for i in range(40)], "short": [(i, 1.0) for i in range(19)]})
    got = T.trend_curve(df, ["site"], "day", "value").collect()
    # The group that can't be fitted says so.
    assert [(r["site"], r["day"], r["pred"], r["status"]) for r in got if r["status"] != "ok"] == [("short", None, None, "insufficient")]
    got = [r for r in got if r["status"] == "ok"]
    assert {r["site"] for r in got} == {"a"} and len(got) == 40
    for r in got:
        assert r["fst_deriv"] == pytest.approx(0.03, abs=1e-6)
        assert r["fst_deriv_ll"] <= r["fst_deriv"] <= r["fst_deriv_ul"]
    status = {r["site"]: r["status"] for r in T.trend_support(df, ["site"], "day", "value").collect()}
    assert status == {"a": "ok", "short": "insufficient"}


def test_wave_is_followed(spark):
    rng = random.Random(1)
    truth = {d: 3 + math.sin(d / 15) for d in range(0, 150, 2)}
    pts = [(d, math.exp(e) * rng.gammavariate(50, 1 / 50)) for d, e in truth.items()]
    df = series(spark, {"a": pts})
    model = T.fit_trends(df, ["site"], "day", "value").first()
    assert model["status"] == "ok"
    assert 4 <= model["k"] <= 15 and model["resid_sd"] < 0.2
    for r in T.trend_curve(df, ["site"], "day", "value").collect():
        d = (r["day"] - D0).days
        if 10 < d < 140:
            assert r["pred"] == pytest.approx(math.exp(truth[d]), rel=0.2)
            assert r["fst_deriv"] == pytest.approx(math.cos(d / 15) / 15, abs=0.03)


def test_outliers_on_the_high_side_only(spark):
    pts = [(i, 100.0 + i % 3) for i in range(60)] + [(60, 1e6), (61, -1e6), (62, None)]
    kept = T.drop_outliers(series(spark, {"a": pts}), ["site"], "value").collect()
    values = {r["value"] for r in kept}
    assert 1e6 not in values and -1e6 in values and None not in values


def test_sums_per_day_equal_single_rows(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.repeat(np.arange(40.0), 3)
    y = np.exp(2 + 0.05 * x + 0.2 * np.sin(x)) * rng.gamma(30, 1 / 30, len(x))
    one = np.ones(len(x))
    by_row = T.fit_smooth(x, one, y, y * y, y * np.log(y), 7)
    days = np.arange(40.0)

    def daily(v):
        return np.array([v[x == d].sum() for d in days])

    by_day = T.fit_smooth(days, daily(one), daily(y), daily(y * y), daily(y * np.log(y)), 7)
    for key in ("resid_sd", "edf", "scale"):
        assert by_day[key] == pytest.approx(by_row[key], rel=1e-3)
    now = T._smooth_at(by_row, days) @ np.array(by_row["coef"])
    then = T._smooth_at(by_day, days) @ np.array(by_day["coef"])
    assert np.allclose(now, then, atol=1e-3)


def test_output_names():
    assert list(T.trend_column_names("inf_a_copies").values()) == ["inf_a_copies_pred", "inf_a_fst_deriv", "inf_a_fst_deriv_ul", "inf_a_fst_deriv_ll"]
    assert T.trend_column_names("rsv_copies")["fst_deriv"] == "rsv_fst_deriv"
    assert T.trend_column_names("sars_cov2_x")["fst_deriv"] == "sars_cov2_fst_deriv"


def test_targets_side_by_side(spark):
    df = series(spark, {"inf_a_x": [(i, math.exp(0.01 * i)) for i in range(30)], "rsv_x": [(i, math.exp(0.02 * i)) for i in range(30)]})
    wide = T.wide_trends(T.trend_curve(df, ["site"], "day", "value"), [], "day", "site", ["inf_a_x", "rsv_x"])
    row = wide.orderBy(F.desc("day")).first()
    assert row["inf_a_fst_deriv"] == pytest.approx(0.01, abs=1e-5) and row["rsv_fst_deriv"] == pytest.approx(0.02, abs=1e-5)


def test_days_are_shipped_a_bounded_number_of_times(spark):
    """Whatever the number of basis sizes, a group's days go to eight tasks at most, and every size is scored."""
    rng = np.random.default_rng(3)
    rows = [("s", dt.date(2021, 1, 1) + dt.timedelta(days=2 * i), float(np.exp(3 + np.sin(i / 9) + rng.normal(scale=0.2)))) for i in range(150)]
    df = spark.createDataFrame(rows, "site string, d date, v double")
    seen = {}
    original = T.choose_model

    def spied(candidates, keys):
        seen["sizes"] = sorted(r["k"] for r in candidates.collect())
        groups = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", candidates._jdf.queryExecution().optimizedPlan().toString())
        seen["groups"] = [re.sub(r"#\d+", "", g) for g in groups]
        return original(candidates, keys)

    T.choose_model = spied
    try:
        chosen = T.fit_trends(df, ["site"], "d", "v").first()
    finally:
        T.choose_model = original
    most = T.trend_support(df, ["site"], "d", "v").first()["k_max"]
    assert seen["sizes"] == list(range(T.K_MIN, most + 1)) and most - T.K_MIN > T._PARTS
    assert seen["groups"] == ["site, part"] and T._PARTS == 8
    assert chosen["k"] in seen["sizes"]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_smoothing_is_the_least_of_a_fine_scan(seed):
    """The search against a scan of the criterion, written anew: penalised least squares on working values, solved to a fixed point."""
    rng = np.random.default_rng(seed)
    x = np.arange(0.0, 120.0, 3.0)
    y = np.exp(2 + np.sin(x / 15) + rng.normal(scale=0.15, size=len(x)))
    one = np.ones(len(x))
    k = 9
    found = T.fit_smooth(x, one, y, y * y, y * np.log(y), k)
    u = (x - x.min()) / (x.max() - x.min())
    knots = np.quantile(u, np.linspace(0, 1, k))
    z = T._centred(knots, u, one)
    design = T._design(knots, u, z)
    penalty = np.zeros((k, k))
    penalty[1:, 1:] = z.T @ T._shrunk(T._curvature(knots)[1], T.SHRINK) @ z
    penalty *= (design**2).sum() / np.abs(penalty).sum(axis=0).max()

    def criterion(weight):
        eta = np.log(y + 0.1)
        for _ in range(500):
            mu = np.exp(eta)
            root = np.sqrt(mu)[:, None]
            # Rows of the penalty's root below the data: one ordinary least squares.
            values, vectors = np.linalg.eigh(weight * penalty)
            below = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
            beta = np.linalg.lstsq(np.vstack([root * design, below]), np.concatenate([root[:, 0] * (eta + y / mu - 1), np.zeros(k)]), rcond=None)[0]
            new = design @ beta
            if np.abs(new - eta).max() < 1e-12:
                break
            eta = new
        mu = np.exp(eta)
        info = design.T @ (mu[:, None] * design)
        edf = np.trace(np.linalg.solve(info + weight * penalty, info))
        deviance = 2 * (y * np.log(y / mu) - y + mu).sum()
        return len(x) * deviance / (len(x) - edf) ** 2, edf

    scan = [criterion(w) for w in np.exp(np.linspace(-20, 20, 801))]
    least, edf = min(scan)
    near = [e for c, e in scan if c <= least * (1 + 1e-6)]
    assert min(near) - 0.05 <= found["edf"] <= max(near) + 0.05
    assert found["edf"] == pytest.approx(edf, abs=0.2)
