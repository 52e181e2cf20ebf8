import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyloom.llm.cutoff import fraction_cutoffs, keep_fraction
from skyloom.llm.percentiles import add_up, from_ladder, ladder, magnitude, percentiles
from skyloom.llm.sample import draw, load_registry, new_entries, register, sampled
from skyloom.llm.topn import top_n

NAN, INF = float("nan"), float("inf")
# columns named as the operators name their own
CLASH = "src string, id long, score double, _source int, n int, lo double, bin int, cutoff double, rank_in_group int, upto int, x int, p int"
REST = (1, 2, 3.0, 4, 5.0, 6, 7, 8, 9)


def table(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], CLASH)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "src string, keep_permille int, score double")


def model(rows, wanted):
    out = {}
    for src, permille in wanted.items():
        s = sorted(x for k, _, x in rows if k == src and x is not None and math.isfinite(x))
        cut = next((x for x in s if sum(y <= x for y in s) * 1000 >= permille * len(s)), s[-1] if s else None)
        out[src] = (permille, len(s), cut, sum(y <= cut for y in s) if s else 0)
    return out


@pytest.mark.parametrize("bins", [2, 3, 64, 4096])
def test_cutoffs_equal_sorting(spark, bins):
    rng = random.Random(bins)
    pool = [20.5, 21.0, -9999.0, 99.99, 1e300, -1e300, 5e-324, 0.0, -0.0, NAN, INF, -INF, None]
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([*pool, rng.uniform(15, 28), rng.uniform(15, 28), rng.gauss(0, 1e-9)])) for i in range(400)]
    rows += [("tied", 1000 + i, 7.0) for i in range(20)] + [("bad", 2000, NAN), ("one", 3000, 1.0)]
    wanted = {"a": 333, "b": 1, "c": 1000, "tied": 100, "bad": 500, "one": 0, "none": 500}
    got = {r["src"]: tuple(r)[1:] for r in fraction_cutoffs(table(spark, rows), targets(spark, wanted.items()), "src", "score", bins=bins).collect()}
    assert got == model(rows, wanted)
    kept = sorted(tuple(r) for r in keep_fraction(table(spark, rows), targets(spark, wanted.items()), "src", "score", "id", bins=bins).collect())
    cuts = model(rows, wanted)
    assert kept == sorted((k, i) for k, i, x in rows if k in cuts and x is not None and math.isfinite(x) and x <= cuts[k][2])


def test_cutoff_edges(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 2.0)]
    t = targets(spark, [("a", 400), ("a", 700), (None, 5), ("b", None)])
    assert [tuple(r) for r in fraction_cutoffs(table(spark, rows), t, "src", "score").collect()] == [("a", 700, 3, 2.0, 3)]
    assert [tuple(r) for r in fraction_cutoffs(table(spark, rows), targets(spark, [("a", 5000)]), "src", "score").collect()] == [("a", 5000, 3, 2.0, 3)]
    assert fraction_cutoffs(table(spark, rows), t.limit(0), "src", "score").count() == 0
    assert [tuple(r) for r in fraction_cutoffs(table(spark, []), t, "src", "score").collect()] == [("a", 700, 0, None, 0)]
    assert keep_fraction(table(spark, []), t, "src", "score", "id").count() == 0
    with pytest.raises(ValueError):
        fraction_cutoffs(table(spark, rows), t, "src", "score", bins=1)


def test_a_shuffled_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.uniform(0, 9)) for i in range(200)]
    wanted = {"a": 100, "b": 500, "c": 999}
    monkeypatch.setattr("skyloom.runtime.BROADCAST_ROWS", 0)
    monkeypatch.setattr("skyloom.llm.cutoff.bounded", lambda df, n: df)
    got = {r["src"]: tuple(r)[1:] for r in fraction_cutoffs(table(spark, rows), targets(spark, wanted.items()), "src", "score").collect()}
    assert got == model(rows, wanted)


def test_top_n(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([1.0, 2.0, NAN, INF, None, 3.0])) for i in range(120)]
    rows += [("a", None, 1.0), ("a", 5, 1.0), ("a", 5, 1.0), ("z", 900, -1.0)]
    key = lambda r: (r[2], r[1] is None, r[1] or 0)
    for n in (0, 1, 4, 1000):
        want = []
        for g in "abz":
            want += sorted((r for r in rows if r[0] == g and r[2] is not None and math.isfinite(r[2])), key=key)[:n]
        got = top_n(table(spark, rows), "src", "score", ["id"], n)
        assert got.columns.count("rank_in_group") == 1
        assert sorted((r["src"], r["id"] is None, r["id"] or 0, r["score"]) for r in got.collect()) == sorted((r[0], r[1] is None, r[1] or 0, r[2]) for r in want)
    best = top_n(table(spark, rows), "src", "score", ["id"], 1, descending=True).where("src = 'a'").first()
    assert best["score"] == 3.0
    assert top_n(table(spark, []), "src", "score", ["id"]).count() == 0


def test_top_n_limits_groups_before_the_shuffle(spark):
    plan = top_n(table(spark, [("a", 1, 1.0)]), "src", "score", ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("seed, counter, want", [(0, 0, 0xFF1DAE59), (0xFFFFFFFF, -1, 0x2C3F628B), (0x13198A2E, 0x85A308D3243F6A88 - (1 << 64), 0xDD7CE038)])
def test_known_draws(spark, seed, counter, want):
    assert spark.createDataFrame([(counter,)], "id long").select(draw(F.col("id"), seed)).first()[0] == want


RATES = {1: 0.5, 2: 0.1}


def test_sample_grows_without_giving_up_picks(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3000), rng.choice([1, 2, 3])) for _ in range(5000)] + [(None, 1), (7, None), (999_999, None)]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "key long, batch int, epoch int, rate double")
    first = new_entries(df.where("batch = 1"), "key", "batch", RATES, 0.05)
    early = {r["key"] for r in sampled(df.where("batch = 1"), "key", first, 11).collect()}
    # rates change later; frozen ones must not
    more = new_entries(df, "key", "batch", {1: 0.0, 2: 0.1}, 0.05, first)
    registry = first.unionByName(more)
    assert registry.count() == registry.select("id").distinct().count() == len({i for i, _ in rows if i is not None})
    late = sampled(df, "key", registry, 11)
    picked = {r["key"] for r in late.collect()}
    assert early <= picked and abs(len(early) / len({i for i, e in rows if e == 1}) - 0.5) < 0.05
    assert late.count() == sum(i in picked for i, _ in rows) and None not in picked
    again = sampled(df.repartition(7), "key", registry.repartition(3), 11)
    assert {r["key"] for r in again.collect()} == picked
    assert {r["key"] for r in sampled(df, "key", registry, 12).collect()} != picked
    assert late.columns == df.columns
    assert sampled(df.limit(0), "key", registry, 1).count() == 0 and new_entries(df.limit(0), "key", "batch", RATES, 0.1).count() == 0
    with pytest.raises(ValueError):
        new_entries(df, "key", "batch", {1: 1.5}, 0.1)


FIRST_DELIVERY = """
from pyspark.sql import SparkSession
from skyloom.llm.sample import register
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([(i, 1) for i in range(500)] + [(i, 2) for i in range(400, 600)], "key long, batch int")
print("registered", register(rows, "key", "batch", {1: 0.5}, 0.25, __import__("sys").argv[1]).count())
"""


def test_a_registry_lasts_from_process_to_process(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    assert load_registry(spark, path).count() == 0
    done = subprocess.run([sys.executable, "-c", FIRST_DELIVERY, path], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert "registered 600" in done.stdout, done.stderr[-2000:]
    early = {r["id"] for r in load_registry(spark, path).where("rate = 0.5").collect()}
    assert early == set(range(500))
    rows = spark.createDataFrame([(i, 1 + i // 500) for i in range(900)] + [(None, 1), (7, None)], "key long, batch int")
    before = {r["key"] for r in sampled(rows.where("key < 600"), "key", load_registry(spark, path), 5).collect()}
    later = register(rows, "key", "batch", {1: 0.0, 2: 1.0}, 1.0, path)  # other rates now: old entries keep theirs
    kept = {r["key"] for r in sampled(rows, "key", later, 5).collect()}
    assert later.count() == 900 and before and before <= kept and set(range(600, 900)) <= kept
    assert kept & set(range(600)) == before
    assert register(rows, "key", "batch", {}, 0.0, path).count() == 900 and spark.read.parquet(path).count() == 900
    # two deliveries at once registered the same identifier
    spark.createDataFrame([(5000, 1, 0.1), (5000, 2, 0.9)], "id long, epoch int, rate double").write.mode("append").parquet(path)
    assert tuple(load_registry(spark, path).where("id = 5000").first()) == (5000, 1, 0.9)


@pytest.mark.parametrize(
    "text, value",
    [("20.261", 20.261), (" 18.875 ", 18.875), ("+19.2", 19.2), ("19.34mag", 19.34), ("19.34 MAG", 19.34), ("17,44", 17.44), ("021.30", 21.3), ("2.134e+01", 21.34), ("-1.5", -1.5), (".5", 0.5), ("5.", 5.0)]
    + [(t, None) for t in ("", "-", "--", "NaN", "inf", "-inf", "N/A", "null", "sat", "99.0", "-99", "999", "1,2,3", "1.2.3", "0x10", "1d", None)],
)
def test_magnitudes(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(magnitude(F.col("t"))).first()[0] == value


PS = (0.0, 0.05, 0.5, 0.95, 1.0)


def ranks(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(p * len(s))) - 1]


def test_percentiles_equal_sorting(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([1.5, -1e300, 1e300, rng.uniform(0, 30), rng.uniform(0, 30), NAN, None, INF])) for i in range(500)] + [("only", 1, 4.0), ("void", 1, NAN)]
    groups = {g: [x for k, _, x in rows if k == g and x is not None and math.isfinite(x)] for g in ("a", "b", None, "only")}
    got = {(r["src"], r["probability"]): (r["n"], r["value"]) for r in percentiles(table(spark, rows), ["src"], "score", PS).collect()}
    assert got == {(g, p): (len(v), ranks(v, p)) for g, v in groups.items() for p in PS}
    everything = [x for v in groups.values() for x in v]
    assert {r["probability"]: r["value"] for r in percentiles(table(spark, rows), [], "score", PS).collect()} == {p: ranks(everything, p) for p in PS}
    small = table(spark, [(k, i, x) for k, i, x in rows if x is not None and abs(x) < 100])
    exact = {(r["src"], r["probability"]): r["value"] for r in percentiles(small, ["src"], "score", PS).collect()}
    rough = {(r["src"], r["probability"]): r["value"] for r in percentiles(small, ["src"], "score", PS, 0.25).collect()}
    assert all(0 <= rough[k] - exact[k] <= 0.25 for k in exact)
    assert percentiles(table(spark, []), ["src"], "score", PS).count() == 0
    with pytest.raises(ValueError):
        percentiles(small, ["src"], "score", [1.1])


def test_days_combine_within_the_error(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(5), rng.gauss(20, 2)) for _ in range(2000)] + [("a", 1, NAN), ("b", 2, None), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "src string, night int, v double")
    days = [ladder(df.where(F.col("night") == i), ["src", "night"], "v", 0.01) for i in range(5)]
    union = days[0]
    for d in days[1:]:
        union = union.unionByName(d)
    got = {(r["src"], r["probability"]): (r["n"], r["value"]) for r in from_ladder(add_up(union, ["src"]), ["src"], PS, 0.01).collect()}
    for g in ("a", "b", None):
        values = [v for k, _, v in rows if k == g and v is not None and math.isfinite(v)]
        for p in PS:
            n, value = got[g, p]
            assert n == len(values) and abs(value - ranks(values, p)) <= 0.01 + 1e-9
    with pytest.raises(ValueError):
        ladder(df, ["src"], "v", 0)
