"""Tail probabilities, rank tests, correlations and scaling."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnkit.functions import tails
from tarnkit.operators import correlation, ranktests, scaling, summaries, timeseries


@pytest.mark.parametrize("statistic,df", [(19.675, 11), (3.841, 1), (5.991, 2), (124.342, 100)])
def test_chi_squared_tail_at_its_five_percent_point(statistic, df):
    assert tails.chi2_upper(statistic, df) == pytest.approx(0.05, abs=2e-5)


def test_normal_and_student_tails():
    assert tails.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.t_two_sided(math.inf, 5) == 0.0


def test_tail_columns_keep_null(spark):
    df = spark.createDataFrame([(None, 3.0), (7.815, 3.0)], "s double, d double")
    got = [r[0] for r in df.select(tails.chi2_p("s", "d")).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.05, abs=1e-5)


def ranks(values):
    return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(11)
    rows = [(n, g, float(rng.randint(0, 12) + shift)) for n in ("x", "y") for shift, g in enumerate("abcd") for _ in range(rng.randint(15, 30))]
    rows += [("x", None, 3.0), ("x", "a", None)]
    return spark.createDataFrame(rows, "name string, location string, value double"), rows


def complete(rows, name):
    return [(g, v) for n, g, v in rows if n == name and g is not None and v is not None]


def test_kruskal_wallis_with_ties_and_missing(long):
    df, rows = long
    got = {r["name"]: r for r in ranktests.kruskal_wallis(df, pieces=5).collect()}
    for name in ("x", "y"):
        data = complete(rows, name)
        r, n = ranks([v for _, v in data]), len(data)
        sums = {g: [x for (h, _), x in zip(data, r) if h == g] for g in "abcd"}
        h = 12 / (n * (n + 1)) * sum(sum(s) ** 2 / len(s) for s in sums.values()) - 3 * (n + 1)
        ties = sum(t**3 - t for t in ([v for _, v in data].count(u) for u in {v for _, v in data}))
        assert got[name]["statistic"] == pytest.approx(h / (1 - ties / (n**3 - n)))
        assert got[name]["df"] == 3
        assert got[name]["p_value"] == pytest.approx(tails.chi2_upper(got[name]["statistic"], 3))


def test_constant_variable_has_no_statistic(spark):
    df = spark.createDataFrame([("k", g, 1.0) for g in "aabb"], "name string, location string, value double")
    assert ranktests.kruskal_wallis(df).first()["statistic"] is None


def test_dunn_pairs(long):
    df, rows = long
    got = {(r["name"], r["group_1"], r["group_2"]): r for r in ranktests.dunn_pairs(df, pieces=5).collect()}
    two = {(r["name"], r["group_1"], r["group_2"]): r for r in ranktests.dunn_pairs(df, alternative="two_sided").collect()}
    assert len(got) == 12
    for name in ("x", "y"):
        data = complete(rows, name)
        r, n = ranks([v for _, v in data]), len(data)
        ties = sum(t**3 - t for t in ([v for _, v in data].count(u) for u in {v for _, v in data}))
        p = {}
        for a, b in combinations("abcd", 2):
            ra, rb = ([x for (h, _), x in zip(data, r) if h == g] for g in (a, b))
            var = (n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / len(ra) + 1 / len(rb))
            z = (sum(ra) / len(ra) - sum(rb) / len(rb)) / math.sqrt(var)
            assert got[name, a, b]["z"] == pytest.approx(z)
            p[a, b] = got[name, a, b]["p_value"]
            assert p[a, b] == pytest.approx(tails.normal_upper(abs(z)))
            assert two[name, a, b]["p_value"] == pytest.approx(2 * p[a, b])
        for pair, adjusted in zip(p, benjamini_hochberg(list(p.values()))):
            assert got[(name, *pair)]["p_adjusted"] == pytest.approx(adjusted)


def benjamini_hochberg(p):
    order = sorted(range(len(p)), key=lambda i: p[i], reverse=True)
    best, out = 1.0, [0.0] * len(p)
    for step, i in enumerate(order):
        best = min(best, p[i] * len(p) / (len(p) - step))
        out[i] = best
    return out


def test_bh_is_monotone_capped_and_ignores_missing(spark):
    p = [0.01, 0.04, 0.03, 0.9, None, 0.03, 0.7]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(p)], "name string, i int, p_value double")
    got = {r["i"]: r["p_adjusted"] for r in ranktests.adjust_bh(df, ["name"], pieces=3).collect()}
    expected = benjamini_hochberg([v for v in p if v is not None])
    assert got[4] is None
    assert [got[i] for i in (0, 1, 2, 3, 5, 6)] == pytest.approx(expected)


def test_significance_uses_the_unrounded_p(spark):
    df = spark.createDataFrame([(0.0499,), (0.0501,), (None,)], "p_adjusted double")
    assert [r["p_adjusted"] for r in ranktests.significant(df).collect()] == [0.0499]


def test_pearson_uses_complete_pairs_and_gives_null_for_constants(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, None, 5.0), (4.0, 7.0, 5.0), (5.0, 6.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["var"], r["var2"]): r for r in correlation.pearson_pairs(df, ["a", "b", "c"], per=2).collect()}
    x, y = [1, 2, 4, 5], [2, 1, 7, 6]
    mx, my = 3, 4
    r = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert got["a", "b"]["n"] == 4 and got["a", "b"]["correlation"] == pytest.approx(r)
    assert got["a", "b"]["p_value"] == pytest.approx(tails.t_two_sided(r * math.sqrt(2 / (1 - r * r)), 2))
    assert got["a", "c"]["correlation"] is None and got["a", "c"]["p_value"] is None


def test_spearman_is_pearson_of_midranks_and_null_when_incomplete(spark):
    rng = random.Random(2)
    rows = [("k", float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(40)] + [("m", 1.0, None), ("m", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "name string, x double, y double")
    got = {r["name"]: r["spearman"] for r in correlation.spearman(df, ["name"], "x", "y", pieces=3).collect()}
    rx, ry = ranks([r[1] for r in rows[:40]]), ranks([r[2] for r in rows[:40]])
    mean = 20.5
    top = sum((a - mean) * (b - mean) for a, b in zip(rx, ry))
    assert got["k"] == pytest.approx(top / math.sqrt(sum((a - mean) ** 2 for a in rx) * sum((b - mean) ** 2 for b in ry)))
    assert got["m"] is None


def test_scaling_round_trip_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 4.0, "a"), (3.0, 4.0, "a"), (None, 4.0, "b")], "x double, k double, g string")
    constants = scaling.scaling_constants(df, ["x", "k"])
    there = scaling.apply_scaling(df, "x", constants, "x", "s")
    back = scaling.undo_scaling(there, "s", constants, "x", "again").collect()
    assert [r["again"] for r in back] == [pytest.approx(1.0), pytest.approx(3.0), None]
    scored = scaling.zscores(df, ["x", "k"]).collect()
    assert scored[0]["s_x"] == pytest.approx(-math.sqrt(0.5)) and scored[0]["s_k"] is None
    grouped = {r["name"]: r for r in scaling.scaling_constants(df, ["x"], ["g"]).filter(F.col("g") == "a").collect()}
    assert grouped["x"]["center"] == 2.0


def test_missing_values_stop_cumulative_work(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0)], "g string, t int, v double")
    with pytest.raises(Exception, match="v must not be NULL"):
        summaries.cumulative(df, ["g"], "t", [], "v").collect()
    with pytest.raises(Exception, match="v must not be NULL"):
        timeseries.autocorrelation(df, ["g"], "t", "v", 1).collect()


def test_bh_with_many_equal_and_missing_values(spark):
    values = [1.0] * 400 + [0.001, 0.02, 0.02, 0.5] + [None] * 300
    df = spark.createDataFrame([("x", k, v) for k, v in enumerate(values)], "g string, id int, p_value double")
    got = {r["id"]: r["p_adjusted"] for r in ranktests.adjust_bh(df, ["g"], pieces=4).collect()}
    present = sorted((v, k) for k, v in enumerate(values) if v is not None)
    best, want = 1.0, {}
    for rank in range(len(present), 0, -1):
        v, k = present[rank - 1]
        best = min(best, v * len(present) / rank)
        want[k] = best
    for k, v in enumerate(values):
        assert got[k] is None if v is None else abs(got[k] - min(1.0, want[k])) < 1e-12
    assert len(got) == len(values)
