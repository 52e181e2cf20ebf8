import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyloom.config import Algorithm
from skyloom.operators import coverage as cv

NAN, INF = float("nan"), float("inf")
TIES = ("ra", "dec", "id")


def table(spark, rows):
    """rows: (id, cell, score); positions follow the id."""
    data = [(i, float(i), 0.0, c, None if s is None or not math.isfinite(s) else float(s)) for i, c, s in rows]
    return spark.createDataFrame(data, "id long, ra double, dec double, __icov__ long, __score__ double")


def hierarchy(spark, rows, density=None, **options):
    a = Algorithm(**({"level_limit": 4} | options))
    chosen = cv.select_hierarchy(table(spark, rows), cv.Selection(a, TIES, "id", density))
    return sorted((r["depth"], r["id"]) for r in chosen.collect())


def model(rows, a):
    """The loop on plain lists: unbiased whole k, ties lost ("reference") or kept."""
    key = lambda r: (r[2] is None, (-r[2] if a.order_desc else r[2]) if r[2] is not None else 0, r[0])
    rest, out = [r for r in rows if r[1] is not None], []
    for depth in range(1, a.level_limit + 1):
        n_cells = len({r[1] for r in rest})
        k = cv.rows_per_cell(a, depth, n_cells)
        if k <= 0:
            continue
        picked = []
        for c in {r[1] for r in rest}:
            picked += sorted((r for r in rest if r[1] == c), key=key)[: math.ceil(k)]
        if not picked:
            break
        out += [(depth, r[0]) for r in picked]
        if a.tie_policy == "keep":
            rest = [r for r in rest if r not in picked]
            continue
        for c in {r[1] for r in picked}:
            kept = [r[2] for r in picked if r[1] == c and r[2] is not None]
            cut = (min(kept) if a.order_desc else max(kept)) if kept else None
            rest = [r for r in rest if r[1] != c or cut is not None and (r[2] is None or (r[2] < cut if a.order_desc else r[2] > cut))]
    return sorted(out)


def test_ties_at_the_cut(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 7, 3)]
    both = {"density_mode": "constant", "k_per_cov_initial": 2.0, "level_limit": 4}
    assert hierarchy(spark, rows, **both) == [(1, 1), (1, 2), (2, 4)]
    assert hierarchy(spark, rows, tie_policy="keep", **both) == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_missing_scores(spark):
    rows = [(1, 7, 1), (2, 7, NAN)]
    both = {"density_mode": "constant", "k_per_cov_initial": 2.0}
    assert hierarchy(spark, rows, **both) == [(1, 1), (1, 2), (2, 2)]
    assert hierarchy(spark, rows, tie_policy="keep", **both) == [(1, 1), (1, 2)]
    assert hierarchy(spark, [(1, 7, -INF), (2, 7, 0)], density_mode="constant", level_limit=1) == [(1, 2)]


def test_order_keys_put_missing_last_either_way(spark):
    df = table(spark, [(1, 1, None), (2, 1, 5), (3, 1, 9)])
    for descending, want in ((False, [2, 3, 1]), (True, [3, 2, 1])):
        assert [r["id"] for r in df.orderBy(*cv.best_first(TIES, descending)).collect()] == want


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("policy", ["reference", "keep"])
def test_loop_equals_the_model(spark, seed, policy):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2, 3, 3]), rng.choice([None, *range(6)])) for i in range(70)]
    options = {"tie_policy": policy, "order_desc": seed % 2 == 1, "density_mode": ["exp", "linear", "constant", "log"][seed], "fractional_mode": "random"}
    if seed == 2:
        options["targets_total_per_level"] = {2: 3, 3: 0}
    if options["density_mode"] == "log":
        options["k_per_cov_per_level"] = {2: 2.0, 4: 0.0}
        options["level_limit"] = 1 if policy == "keep" else 2
    rows = [(i, c, None if s is None else float(s)) for i, c, s in rows]
    a = Algorithm(**({"level_limit": 4} | options))
    assert hierarchy(spark, rows, **options) == model(rows, a)


def test_whole_k_at_once_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(5), float(rng.randrange(20))) for i in range(200)]
    a = Algorithm(level_limit=4, tie_policy="keep")
    assert cv.can_select_at_once(a)
    s = cv.Selection(a, TIES, "id", None)
    got = sorted((r["depth"], r["id"]) for r in cv.select_at_once(table(spark, rows), s).collect())
    assert got == model(rows, a)


def test_profiles():
    want = {"constant": [1, 1, 1, 1], "linear": [1, 2, 3, 4], "exp": [1, 2, 4, 8], "log": [1, math.log2(3), 2, math.log2(5)]}
    for mode, values in want.items():
        assert [cv.profile(mode, 1.0, d) for d in range(1, 5)] == pytest.approx(values)
    assert cv.profile("exp", 1.0, 3, 0.5) == 4
    with pytest.raises(ValueError):
        cv.profile("cubic", 1.0, 1)


def test_caps_and_overrides():
    a = Algorithm(level_limit=4, targets_total_per_level={1: 0, 2: 5}, k_per_cov_per_level={3: -2.0})
    assert cv.rows_per_cell(a, 1, 10) == 1.0
    assert cv.rows_per_cell(a, 2, 10) == 0.5
    assert cv.rows_per_cell(a, 3, 10) == 0.0
    t = Algorithm(level_limit=4, targets_total_initial=30.0)
    assert cv.rows_per_cell(t, 2, 10) == 6.0 and cv.rows_per_cell(t, 2, 0) == 0.0
    assert cv.needs_cell_count(t, 1) and cv.needs_cell_count(a, 2) and not cv.needs_cell_count(a, 4)


def test_nothing_to_select(spark):
    assert hierarchy(spark, [(1, 1, 1)], k_per_cov_initial=0.0) == []
    assert hierarchy(spark, []) == []
    assert hierarchy(spark, [(1, None, 1)]) == []


def test_bias(spark):
    cells = spark.createDataFrame([(0, 100), (1, 25), (2, 0)], "__icov__ long, n long")
    weights = cv.bias_weights(cells, "proportional", -0.5)
    limits = {r["__icov__"]: (r["k_cell"], r["k"]) for r in cv.integer_limits(weights, 1.5).collect()}
    assert limits[0][0] == pytest.approx(1.99999999, abs=1e-7) and limits[1][0] == pytest.approx(1.00000001, abs=1e-7)
    assert {c: k for c, (_, k) in limits.items()} == {0: 2, 1: 2}
    rows = [(i, i % 3, float(i)) for i in range(12)]
    got = cv.top_k_by_cell(table(spark, rows), cv.integer_limits(weights, 1.5), cv.best_first(TIES, False))
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 3, 4]


@pytest.mark.parametrize("mode", ["score", "random"])
def test_fractions(spark, mode):
    rows = [(i, i % 40, float(i)) for i in range(120)]
    chosen = cv.top_k(table(spark, rows), 2, cv.best_first(TIES, False)).drop(cv.RANK)
    order = cv.best_first(TIES, False)
    pick = lambda logic, seed=1, limits=None, k=1.5: sorted((r[cv.CELL], r["id"]) for r in cv.fractional(chosen, k, mode, logic, order, F.col("id"), seed, limits).collect())
    assert len(pick("global")) == 60
    local = pick("local")
    per = [sum(c == cell for c, _ in local) for cell in range(40)]
    assert set(per) == {1, 2} and pick("local") == local and pick("local", 2) != local
    assert len(pick("local", k=2.0)) == 80
    assert len(pick("auto", k=0.0)) == 80
    limits = spark.createDataFrame([(0, 0.0), (1, 5.0)], "__icov__ long, k_cell double")
    biased = pick("local", limits=limits)
    assert sum(c == 0 for c, _ in biased) == 0 and sum(c == 1 for c, _ in biased) == 2
    if mode == "score":
        assert pick("global") == sorted((r[1], r[0]) for r in sorted(rows[:80], key=lambda r: r[2])[:60])


def test_logic_names():
    assert cv.resolve_logic("score", "auto") == ("score", "global") and cv.resolve_logic("random", None) == ("random", "local")
    for bad in (("best", "local"), ("score", "everywhere")):
        with pytest.raises(ValueError):
            cv.resolve_logic(*bad)


def test_first_rows_by_range(spark, monkeypatch):
    df = table(spark, [(i, 0, float(i * 7 % 101)) for i in range(300)])
    order = cv.best_first(TIES, False)
    want = [r["id"] for r in df.orderBy(*order).limit(123).collect()]
    monkeypatch.setattr(cv, "SMALL_LIMIT", 10)
    assert sorted(r["id"] for r in cv.first_rows(df, 123, order).collect()) == sorted(want)
    assert cv.first_rows(df.limit(0), 50, order).count() == 0


@pytest.mark.parametrize("mode", ["score", "random"])
def test_fractions_are_drawn_afresh_at_each_depth(spark, mode):
    rows = [(i, i % 1000, float(i)) for i in range(12_000)]
    chosen = hierarchy(spark, rows, density_mode="constant", k_per_cov_initial=0.5, level_limit=6, fractional_mode=mode, fractional_mode_logic="local", tie_policy="keep")
    per = Counter(i % 1000 for _, i in chosen)
    assert 3 <= 1000 - len(per) <= 40 and 2800 < len(chosen) < 3200  # 1000 / 2^6 cells stay empty on average
    depths = Counter(d for d, _ in chosen)
    assert all(420 < depths[d] < 580 for d in range(1, 7))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("policy", ["reference", "keep"])
def test_within_cells_equals_depth_by_depth(spark, monkeypatch, seed, policy):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2, 3, 3]), rng.choice([None, *range(8)])) for i in range(120)]
    density = spark.createDataFrame([(1, 20), (2, 30), (3, 70)], "__icov__ long, n long")
    options = {"tie_policy": policy, "order_desc": seed % 2 == 1, "density_mode": ["exp", "linear", "constant"][seed % 3], "fractional_mode": ["random", "score"][seed % 2], "fractional_mode_logic": "local", "k_per_cov_initial": [0.6, 1.0, 1.7][seed % 3], "seed": seed}
    if seed > 2:
        options["density_bias_mode"] = "inverse"
    got = hierarchy(spark, rows, density, **options)
    monkeypatch.setattr(cv, "can_select_within_cells", lambda a: False)
    assert got == hierarchy(spark, rows, density, **options)
    monkeypatch.setattr(cv, "contenders", lambda rows, s, most: rows)
    assert got == hierarchy(spark, rows, density, **options)


def test_very_many_equal_scores(spark):
    rows = [(i, 7, 5.0) for i in range(3000)] + [(10_000 + i, 7, None) for i in range(3000)] + [(20_000 + i, i % 3, float(i)) for i in range(60)]
    both = {"density_mode": "constant", "k_per_cov_initial": 2.0, "tie_policy": "reference"}
    a = Algorithm(level_limit=4, **both)
    kept = cv.contenders(table(spark, rows), cv.Selection(a, TIES, "id", None), [2, 2, 2, 2])
    assert kept.where("__icov__ = 7").count() == 4
    assert hierarchy(spark, rows, **both) == model(rows, a)


def test_contenders_are_limited_before_the_shuffle(spark):
    df = table(spark, [(i, i % 50, float(i)) for i in range(500)])
    for policy in ("reference", "keep"):
        a = Algorithm(level_limit=4, tie_policy=policy)
        plan = cv.contenders(df, cv.Selection(a, TIES, "id", None), [1, 2, 4, 8])._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange hashpartitioning")[1:]:
            assert "WindowGroupLimit" in part, plan


def test_a_profile_of_totals(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(6), float(rng.randrange(30))) for i in range(200)]
    options = {"targets_total_initial": 12.0, "density_mode": "linear", "tie_policy": "keep"}
    assert hierarchy(spark, rows, **options) == model(rows, Algorithm(level_limit=4, **options))
