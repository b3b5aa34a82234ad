import random
import statistics

import pytest
from pyspark.sql import functions as F

from faultline.functions import ordered
from faultline.functions.ordered import carry_last, id_bucket, number_rows, quantiles, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, rng.choice([None, i])) for i in range(2000)]
    return spark.createDataFrame(rows, "k string, line long, v long").cache(), rows


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_number_rows(skewed, width):
    df, rows = skewed
    got = {r.line: r.pos for r in number_rows(df, ["k"], ["line"], id_bucket("line", width)).collect()}
    seen: dict = {}
    for k, line, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[line] == seen[k]


@pytest.mark.parametrize("before", [True, False])
@pytest.mark.parametrize("width", [3, 500])
def test_carry_last(skewed, width, before):
    df, rows = skewed
    got = {r.line: r.c for r in carry_last(df, ["k"], ["line"], id_bucket("line", width), F.col("v"), "c", before).collect()}
    last: dict = {}
    for k, line, v in rows:
        if before:
            assert got[line] == last.get(k)
        if v is not None:
            last[k] = v
        if not before:
            assert got[line] == last.get(k)


def test_running_sum_without_keys(skewed):
    df, rows = skewed
    out = running_sum(df, [], ["line"], id_bucket("line", 50), {"s": F.coalesce("v", F.lit(0))}).orderBy("line").collect()
    total = 0
    for r in out:
        total += r.v or 0
        assert r.s == total


def test_quantiles_of_a_heavy_tail(spark):
    rng = random.Random(2)
    values = [round(rng.lognormvariate(0, 4), 3) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, [], "x", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q4": 1.0}).first()
    cuts = statistics.quantiles(values, n=4, method="inclusive")
    assert got.q0 == min(values) and got.q4 == max(values)
    assert got.q1 == pytest.approx(cuts[0]) and got.q2 == pytest.approx(cuts[1])


def test_no_window_over_a_bare_key(skewed):
    df, _ = skewed
    plan = number_rows(df, ["k"], ["line"], id_bucket("line", 100))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("_b" in w.split("], [")[1] for w in windows if "], [" in w)


def test_sample_is_the_same_with_and_without_the_bound(spark):
    from faultline.functions.ordered import smallest_hashes

    df = spark.range(20_000)
    got = {r.id for r in smallest_hashes(df, "id", 100).collect()}
    want = {r.id for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(100).collect()}
    assert got == want


def test_sample_of_repeated_keys_is_whole(spark):
    from faultline.functions.ordered import smallest_hashes

    df = spark.range(50_000).select((F.col("id") % 5).alias("id"))
    assert smallest_hashes(df, "id", 400).count() == 400 and smallest_hashes(df.limit(3), "id", 400).count() == 3


def test_null_keys_are_a_group(spark):
    from faultline.operators import profile as pf

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, x double")
    got = {r.k: (r.q0, r.q50, r.q100) for r in pf.five_numbers(df, "x", ["k"]).collect()}
    assert got == {"a": (1.0, 2.0, 3.0), None: (5.0, 6.0, 7.0)}
    assert {r.k for r in pf.histogram(df, "x", 2, ("k",)).collect()} == {"a", None}


def test_smallest_rows_equal_a_sort(spark):
    import random

    from faultline.functions.ordered import smallest_hashes, smallest_rows

    rng = random.Random(3)
    values = [rng.choice([rng.randint(-5, 5), rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 10**6)]) for _ in range(3000)] + [None] * 5
    values += [-(2**63), 2**63 - 1, 7, 7, 7, 7]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(7)
    plain = sorted((v, i) for i, v in enumerate(values) if v is not None)
    for n in (1, 3, 64, 500, 5000):
        got = [(r.v, r.i) for r in smallest_rows(df, "v", n, ["i"]).collect()]
        assert got == plain[:n]
    assert smallest_rows(df.where("v IS NULL"), "v", 3).count() == 0
    hashed = sorted((r.h, r.i) for r in df.select("i", F.xxhash64(F.col("i"), F.lit(42)).alias("h")).collect())
    for n in (1, 100, 9999):
        assert sorted(r.i for r in smallest_hashes(df, "i", n).collect()) == sorted(i for _, i in hashed[:n])
    assert smallest_hashes(df.limit(0), "i", 5).count() == 0


def test_the_last_sort_meets_few_rows_of_each_task(spark):
    """With 50 tasks of 2,000 rows, ten smallest hashes must not mean ten rows of every task in one."""
    from faultline.functions.ordered import smallest_hashes

    found = smallest_hashes(spark.range(100_000).repartition(50).withColumnRenamed("id", "i"), "i", 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 10 and "_hash" in plan and "<=" in plan
    bound = found.sparkSession.range(100_000).select(F.xxhash64(F.col("id"), F.lit(42)).alias("h")).orderBy("h").limit(21).agg(F.max("h")).first()[0]
    limit = int(plan.split("<= ")[1].split(")")[0])
    assert limit <= bound


def test_series_and_splits_keep_rows_without_a_key(spark):
    from faultline.operators.models import stratified_split
    from faultline.operators.series import normalize

    points = spark.createDataFrame([(None, "m", 1.0), (None, "m", 3.0), ("s", None, 5.0), ("s", "m", 2.0)], "sample_id string, metric string, value double")
    got = {(r.sample_id, r.metric, r.value): r.scaled for r in normalize(points).collect()}
    assert len(got) == 4 and got[None, "m", 1.0] == 0.0 and got[None, "m", 3.0] == 1.0
    rows = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "id long, label string")
    split = stratified_split(rows, "label", "id", 0.2)
    assert split.count() == 30 and {r.label: r.n for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {None: 2, "a": 2, "b": 2}


def test_sketches_of_parts_merge_within_their_bound(spark):
    import numpy as np

    from faultline.operators import profile as pf

    values = np.random.default_rng(1).lognormal(0, 2, 20_000)
    df = spark.createDataFrame([(i % 7, float(x)) for i, x in enumerate(values)] + [(0, None), (1, float("nan"))], "part int, x double").repartition(9)
    parts = pf.quantile_sketches(df, "x", ["part"])
    assert parts.count() == 7
    whole = pf.sketched_five_numbers(pf.merge_sketches(parts)).first()
    assert whole["rows"] == 20_000 and whole.q0 == values.min() and whole.q100 == values.max()
    for p in (0.25, 0.5, 0.75):
        assert abs((values <= whole[f"q{int(100 * p)}"]).mean() - p) < 2.3 / 400


def test_quantiles_see_the_same_edges_in_every_branch(spark, monkeypatch):
    """Edges that come out otherwise each time they are computed, as approximate ones do when tasks end in another order."""
    cuts = F.udf(lambda top: sorted(random.uniform(0, top) for _ in range(9)), "array<double>")
    monkeypatch.setattr(ordered, "edges", lambda value: cuts(F.max(value)))
    rng = random.Random(4)
    values = [rng.uniform(0, 100) for _ in range(999)]
    df = spark.createDataFrame([("a", x) for x in values], "k string, v double")
    want = sorted(values)
    for keys in (["k"], []):
        for _ in range(3):
            got = quantiles(df, keys, "v", {"q25": 0.25, "q50": 0.5}).first()
            assert got.q50 == want[499] and abs(got.q25 - (want[249] + want[250]) / 2) < 1e-9
