"""The wide feature matrix of samples and the search in it."""

import tracemalloc

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faultline.operators import features as ft
from faultline.operators import neighbours as nb
from faultline.plans import features as fp
from faultline.plans import models as mq


def test_a_few_long_vectors_do_not_loosen_the_filter():
    """One far target made nearly every pair of a wide matrix a candidate, and their exact distances took a gigabyte."""
    rng = np.random.default_rng(3)
    queries, targets = rng.normal(0, 1, (256, 400)), rng.normal(0, 1, (4096, 400))
    targets[7, 0] = 3e3
    before = targets.nbytes + queries.nbytes
    tracemalloc.start()
    found = nb._nearest(5, queries, targets, np.arange(len(targets)))
    row, dist, name = found if isinstance(found, tuple) else next(iter(found))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * before
    for i in range(0, 256, 51):
        gaps = np.sqrt(((queries[i] - targets) ** 2).sum(1))
        want = np.lexsort((np.arange(len(targets)), gaps))[:5]
        assert name[row == i].tolist() == want.tolist() and dist[row == i].tolist() == gaps[want].tolist()


def test_predictions_are_computed_once(spark):
    """The properties of held-out predictions read them several times; a search behind them must run once."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    held = spark.createDataFrame([(i, i % 3 > 0, i % 2) for i in range(30)], "id long, _l boolean, prediction int")
    held = held.select("id", F.col("_l").cast("int").alias("label"), "prediction").mapInPandas(seen, "id long, label int, prediction int")
    out = mq.held_properties(held).first()
    assert (out.rows, out.known_labels) == (30, True) and calls.value == 30


def test_entries_become_dense_arrays_and_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [(0, 0.5), (3, 2.0), (4, -1.0)]), (1, [(2, 7.0)]), (2, []), (3, None)], "id long, entries array<struct<i: int, w: double>>"
    )
    got = [r[0] for r in rows.orderBy("id").select(ft.dense("entries", 6)).collect()]
    assert got == [[0.5, 0.0, 0.0, 2.0, -1.0, 0.0], [0.0, 0.0, 7.0, 0.0, 0.0, 0.0], [0.0] * 6, [0.0] * 6]
    odd = spark.createDataFrame([(0, [1.0, None, float("nan"), 2.0])], "id long, features array<double>")
    packed = ft.packed_vectors(odd, "features", 4).select("id", vector_to_array("features").alias("x")).first()
    assert packed.x == [1.0, 0.0, 0.0, 2.0]


def test_sample_matrix_is_one_array_per_sample(spark, tmp_path):
    """Hundreds of columns took more planning and aggregation than the numbers in them."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 7, kinds[i * i % 5], float(i % 11), f'{{"k": {i}}}') for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    table, names = fp.sample_matrix(spark, str(tmp_path))
    assert table.columns == ["sample_id", "features"]
    got = {r.sample_id: dict(zip(names, r.features, strict=True)) for r in table.collect()}
    assert set(got) == {str(u) for u in range(7)}
    for user, cells in got.items():
        mine = [r for r in rows if r[2] == int(user)]
        assert cells["log_lines"] == len(mine) and cells["log_error"] == sum(r[3] == "error" for r in mine)
        clicks = [r[4] for r in mine if r[3] == "click"]
        assert abs(cells["metric_response_time_ms_mean"] - (sum(clicks) / len(clicks) if clicks else 0.0)) < 1e-12
        terms = {n: w for n, w in cells.items() if n.startswith("tfidf_")}
        assert abs(sum(w * w for w in terms.values()) - 1) < 1e-9
        block = "tfidf_blk_" if int(user) % 2 else f"tfidf_blk_{user}"  # an odd user's block has a sign before its number
        assert terms[block] > 0 and all(w == 0 for n, w in terms.items() if n.startswith("tfidf_blk_") and n != block)
    frame, _ = mq.labelled_samples(spark, str(tmp_path))
    scaled = {str(r.id): (r.label, r.x) for r in frame.select("id", "label", vector_to_array("features").alias("x")).collect()}
    whole = np.array([list(got[u].values()) for u in sorted(got)])
    spread = whole.std(0)
    want = np.where(spread > 1e-12, (whole - whole.mean(0)) / np.where(spread > 1e-12, spread, 1), 0)
    assert np.allclose([scaled[u][1] for u in sorted(got)], want)
    assert all(scaled[u][0] == int(got[u]["log_error_share"] > 0.2) for u in got)


def test_classes_are_fitted_together():
    from faultline.operators import models as md

    assert md.gradient_boosting(classes=3).getParallelism() == 3
