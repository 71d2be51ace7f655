"""Ordered work in pieces against plain Python, with hot groups, hot values and missing values."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnkit.operators import quantiles, timeseries
from tarnkit.operators.ordering import big_groups, in_pieces, midranks, order_number, positions, running, trailing


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third of the rows at one value, a NULL group."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        value = 7.0 if rng.random() < 0.34 else round(rng.gauss(0, 10), 1)
        rows.append((i, group, value, rng.randint(1, 9)))
    return spark.createDataFrame(rows, "id bigint, g string, v double, w int").repartition(6), rows


def by_group(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    return groups


def test_pieces_follow_the_order_and_split_hot_groups_and_values(skewed):
    df, rows = skewed
    placed, cut = in_pieces(df, [], order_number(df, "v"), ["id"], pieces=8)
    assert cut
    got = [(r["_piece"], r["_part"], r["v"], r["id"]) for r in placed.collect()]
    by_place = [(v, i) for _, _, v, i in sorted(got)]
    assert by_place == sorted((r[2], r[0]) for r in rows)
    sizes = defaultdict(int)
    for piece, part, _, _ in got:
        sizes[piece, part] += 1
    assert max(sizes.values()) < 3000 / 8 * 2


def test_only_big_groups_are_cut(skewed, spark):
    df, _ = skewed
    placed, cut = in_pieces(df, ["g"], order_number(df, "v"), ["id"], pieces=4)
    pieces = {r["g"]: r["n"] for r in placed.groupBy("g").agg(F.countDistinct("_piece").alias("n")).collect()}
    assert cut and pieces["hot"] > 1 and pieces["a"] == pieces["b"] == pieces[None] == 1
    many = spark.range(100).withColumn("g", F.col("id") % 50)
    placed, cut = in_pieces(many, ["g"], order_number(many, "id"), pieces=10)
    assert not cut and placed.select("_piece").distinct().count() == 1


def test_a_hot_value_is_split_even_when_ties_follow_the_order(spark):
    rows = [(i, 5 if i < 400 else 6 if i < 800 else 7 + i % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, v int")
    placed, _ = in_pieces(df, [], order_number(df, "v"), ["id"], pieces=12)
    sizes = [r["count"] for r in placed.groupBy("_piece", "_part").count().collect()]
    assert max(sizes) <= 1200 / 12 * 2 and len(sizes) <= 24
    got = {r["id"]: r["position"] for r in positions(df, [], "v", ["id"], pieces=12).collect()}
    assert [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] == sorted(got, key=got.get)


@pytest.mark.parametrize("descending,pieces", [(False, 8), (True, 8), (False, 2), (False, 1), (True, 60)])
def test_positions(skewed, descending, pieces):
    df, rows = skewed
    got = {r["id"]: r["position"] for r in positions(df, ["g"], "v", ["id"], descending=descending, pieces=pieces).collect()}
    for members in by_group(rows).values():
        order = sorted(members, key=lambda r: (-r[2] if descending else r[2], r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("pieces", [1, 4, 30])
def test_running_sums_minima_maxima_totals(skewed, pieces):
    df, rows = skewed
    result = running(
        df, ["g"], "v", ["id"], sums={"s": F.col("w")}, mins={"lo": F.col("w")}, maxs={"hi": F.col("w")},
        totals={"t": F.col("w")}, pieces=pieces,
    )
    got = {r["id"]: (r["s"], r["lo"], r["hi"], r["t"]) for r in result.collect()}
    assert len(got) == len(rows)
    for members in by_group(rows).values():
        total, s, lo, hi = sum(r[3] for r in members), 0, 99, 0
        for r in sorted(members, key=lambda r: (r[2], r[0])):
            s, lo, hi = s + r[3], min(lo, r[3]), max(hi, r[3])
            assert got[r[0]] == (s, lo, hi, total)


@pytest.mark.parametrize("pieces", [1, 4, 30])
def test_running_takes_equal_values_together(skewed, pieces):
    df, rows = skewed
    result = running(df, ["g"], "v", sums={"s": F.lit(1)}, peers={"p": F.lit(1)}, pieces=pieces)
    got = {r["id"]: (r["s"], r["p"]) for r in result.collect()}
    for members in by_group(rows).values():
        for r in members[:40]:
            expected = (sum(o[2] <= r[2] for o in members), sum(o[2] == r[2] for o in members))
            assert got[r[0]] == expected


def test_missing_order_values_come_last(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, None)], "id int, v double")
    got = {r["id"]: r["position"] for r in positions(df, [], "v", ["id"], pieces=4).collect()}
    assert got == {3: 1, 1: 2, 2: 3, 4: 4}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, id int, v double")
    assert positions(df, ["g"], "v", ["id"]).count() == 0
    assert quantiles.group_quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("pieces", [1, 7, 400])
def test_trailing_matches_lags_even_across_tiny_pieces(skewed, pieces):
    df, rows = skewed
    result = trailing(
        df, ["g"], "v", 3, lambda w: {"l1": F.lag("w", 1).over(w), "l3": F.lag("w", 3).over(w), "s": F.sum("w").over(w.rowsBetween(-2, 0))},
        ["id"], pieces,
    )
    got = {r["id"]: (r["l1"], r["l3"], r["s"]) for r in result.collect()}
    assert len(got) == len(rows)
    for members in by_group(rows).values():
        w = [r[3] for r in sorted(members, key=lambda r: (r[2], r[0]))]
        for n, r in enumerate(sorted(members, key=lambda r: (r[2], r[0]))):
            expected = (w[n - 1] if n >= 1 else None, w[n - 3] if n >= 3 else None, sum(w[max(0, n - 2): n + 1]))
            assert got[r[0]] == expected


def test_group_quantiles_are_linear_interpolations(skewed):
    df, rows = skewed
    result = quantiles.group_quantiles(df, ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.9}, pieces=8).collect()
    for r in result:
        values = sorted(m[2] for m in by_group(rows)[r["g"]])
        for name, p in (("a", 0.025), ("b", 0.5), ("c", 0.9)):
            at = (len(values) - 1) * p
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert r[name] == pytest.approx(values[low] + (at - low) * (values[high] - values[low]))
    assert len(result) == 4


def test_quantiles_agree_with_spark_percentile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    got = quantiles.group_quantiles(df, [], "v", {"q": 0.25, "u": 0.975}).first()
    assert (got["q"], got["u"]) == (1.75, pytest.approx(8.625))


@pytest.mark.parametrize("pieces", [1, 4, 30])
def test_midranks_sum_and_ties(skewed, pieces):
    df, rows = skewed
    got = {r["id"]: r["midrank"] for r in midranks(df, ["g"], "v", pieces=pieces).collect()}
    for members in by_group(rows).values():
        n = len(members)
        assert sum(got[r[0]] for r in members) == pytest.approx(n * (n + 1) / 2)
        hot = {got[r[0]] for r in members if r[2] == 7.0}
        assert len(hot) == 1


@pytest.mark.parametrize("pieces", [1, 2, 3, 50])
def test_midranks_of_missing_values_are_missing(spark, pieces):
    rows = [("a", 3.0), ("a", None), ("a", 1.0), ("a", 3.0), ("b", None), ("c", None), ("c", 8.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranked = midranks(df, ["g"], "v", pieces=pieces).collect()
    got = sorted((r["g"], r["v"], r["midrank"]) for r in ranked if r["v"] is not None)
    assert got == [("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("c", 8.0, 1.0)]
    assert [r["midrank"] for r in ranked if r["v"] is None] == [None] * 3
    whole = midranks(df, [], "v", pieces=pieces).collect()
    assert sorted(r["midrank"] for r in whole if r["v"] is not None) == [1.0, 2.5, 2.5, 4.0]


def test_rolling_needs_full_windows_and_skips_missing(spark):
    rows = [("a", i, None if i == 2 else float(i)) for i in range(1, 6)] + [("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    result = timeseries.rolling(df, ["g"], "d", {"s": ("sum", "v", 3), "m": ("mean", "v", 3)}, pieces=3)
    got = {(r["g"], r["d"]): (r["s"], r["m"]) for r in result.collect()}
    assert got["a", 2] == (None, None) and got["b", 1] == (None, None)
    assert got["a", 3] == (4.0, 2.0) and got["a", 5] == (12.0, 4.0)


def test_rolling_sum_over_missing_is_zero_and_mean_is_null(spark):
    df = spark.createDataFrame([(i, None) for i in range(1, 4)], "d int, v double")
    result = timeseries.rolling(df, [], "d", {"s": ("sum", "v", 3), "m": ("mean", "v", 3)})
    assert {r["d"]: (r["s"], r["m"]) for r in result.collect()}[3] == (0.0, None)


def test_rolling_days_looks_back_across_blocks_and_gaps(spark):
    rng = random.Random(3)
    days = sorted(rng.sample(range(19000, 19400), 150))
    rows = [(rng.choice("ab"), d, float(rng.randint(0, 9))) for d in days for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "g string, n int, v double").withColumn("d", F.date_from_unix_date("n"))
    result = timeseries.rolling_days(df, ["g"], "d", {"s": ("sum", "v", 7), "m": ("mean", "v", 3)}, block=16)
    got = {(r["g"], r["n"]): (r["s"], r["m"]) for r in result.withColumn("n", F.unix_date("d")).collect()}
    assert set(got) == {(g, d) for g, d, _ in rows}
    for (g, d), (s, m) in got.items():
        near = [v for h, e, v in rows if h == g and d - 2 <= e <= d]
        assert s == sum(v for h, e, v in rows if h == g and d - 6 <= e <= d)
        assert m == pytest.approx(sum(near) / len(near))


def test_autocorrelation(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("s", i, v + 1e6) for i, v in enumerate(x)], "g string, t int, v double")
    got = {r["lag"]: r["acf"] for r in timeseries.autocorrelation(df, ["g"], "t", "v", 2, pieces=3).collect()}
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    for k in (1, 2):
        assert got[k] == pytest.approx(sum((x[i] - mean) * (x[i - k] - mean) for i in range(k, len(x))) / spread)
    assert got[0] == 1.0


def test_wall_clock_order_in_a_zone_with_a_gap(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Halifax")
    try:
        times = ["2023-03-12 01:59:59.5", "2023-03-12 02:30:00", "2023-03-12 02:30:00.25", "2023-03-12 03:00:00", "1969-12-31 23:59:59.75"]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id int, t string").selectExpr(
            "id", "cast(t AS timestamp_ntz) AS t")
        for pieces in (1, 3):
            rows = positions(df, [], "t", ["id"], pieces=pieces).orderBy("position").collect()
            assert [r["id"] for r in rows] == [4, 0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_missing_values_enter_no_window_of_midranks(spark):
    df = spark.createDataFrame([(k, None if k % 5 < 2 else float(k % 50)) for k in range(4000)], "id int, v double")
    ranked = midranks(df, [], "v", pieces=8)
    assert ranked.where("v IS NULL AND midrank IS NOT NULL").count() == 0
    assert ranked.count() == 4000 and ranked.agg({"midrank": "sum"}).first()[0] == 2400 * 2401 / 2


def test_text_is_sorted_both_ways_with_hot_and_missing_values(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        chance = rng.random()
        text = "same" if chance < 0.33 else None if chance < 0.6 else rng.choice(["", "same\0", "é", "日本", "z"]) + str(rng.randint(0, 300))
        rows.append((i, rng.choice(["hot", "hot", "hot", "a"]), text))
    df = spark.createDataFrame(rows, "id bigint, g string, v string").repartition(5)
    for keys in ([], ["g"]):
        for descending in (False, True):
            got = {r["id"]: r["position"] for r in positions(df, keys, "v", ["id"], descending=descending, pieces=8).collect()}
            for group in {r[1] for r in rows} if keys else {None}:
                inside = [r for r in rows if not keys or r[1] == group]
                known = sorted((r for r in inside if r[2] is not None), key=lambda r: r[0])
                known.sort(key=lambda r: r[2].encode(), reverse=descending)
                wanted = known + [r for r in inside if r[2] is None]
                assert [got[r[0]] for r in wanted] == list(range(1, len(inside) + 1))


def test_no_piece_of_text_or_missing_values_holds_much_more_than_its_share(spark):
    rows = [(i, "same" if i % 3 == 0 else None if i % 3 == 1 else f"{i * 7919 % 3000:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, v string")
    for descending in (False, True):
        placed, _ = in_pieces(df, [], order_number(df, "v"), ["id"], pieces=10, descending=descending)
        sizes = [r["count"] for r in placed.groupBy("_piece", "_part").count().collect()]
        assert max(sizes) <= 3000 / 10 * 2 and sum(sizes) == 3000


def test_missing_numbers_are_split_too(spark):
    rows = [(i, None if i % 2 else float(i % 17)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    placed, _ = in_pieces(df, [], order_number(df, "v"), ["id"], pieces=10)
    assert max(r["count"] for r in placed.groupBy("_piece", "_part").count().collect()) <= 2 * 2000 / 10
    got = {r["id"]: r["position"] for r in positions(df, [], "v", ["id"], pieces=10).collect()}
    wanted = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    assert [got[r[0]] for r in wanted] == list(range(1, 2001))


def test_order_by_absolute_value(spark):
    rows = [(i, None if i % 10 == 0 else (-1) ** i * float(i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = {r["id"]: r["position"] for r in positions(df, [], "v", ["id"], descending=True, absolute=True, pieces=6).collect()}
    wanted = sorted(rows, key=lambda r: (r[1] is None, -abs(r[1] or 0.0), r[0]))
    assert [got[r[0]] for r in wanted] == list(range(1, 501))
    with pytest.raises(TypeError):
        order_number(spark.createDataFrame([("a",)], "v string"), "v", absolute=True)


def test_big_groups_are_found_with_missing_keys_and_empty_tables(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 500, -1).otherwise(F.col("id")))
    df = df.withColumn("h", F.when(F.col("id") < 500, None).otherwise("x"))
    assert [tuple(r) for r in big_groups(df, ["g"], 4).collect()] == [(-1,)]
    assert sorted(map(tuple, big_groups(df, ["h"], 4).collect()), key=str) == [("x",), (None,)]
    assert big_groups(spark.range(100), ["id"], 4) is None
    assert big_groups(spark.range(0), ["id"], 4) is None
