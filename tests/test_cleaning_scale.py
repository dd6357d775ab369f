"""Work of the station flows that must not grow again: sorts, passes and memory of the fills."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.operators import clusters, forest
from raingrid.operators import impute as I
from raingrid.operators import patterns as L
from raingrid.operators import windows as W
from raingrid.operators.align import nearest_within

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def days(spark):
    rng, rows = np.random.default_rng(3), []
    for s in range(3):
        for i in range(150):
            known = lambda x: None if rng.random() < 0.3 else float(x)
            t = 25 + rng.normal()
            rows.append((f"s{s}", DAY + dt.timedelta(days=i), known(t), known(t - 4), known(t + 4),
                         known(70 + rng.normal()), known(rng.integers(0, 360))))
    df = spark.createDataFrame(rows, "series string, ds date, tavg double, tn double, tx double, rh double, d double")
    return df.repartition(4)


def same(a, b):
    plain = lambda r: [f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]
    assert sorted(map(plain, a.collect())) == sorted(map(plain, b.select(a.columns).collect()))


def test_fills_that_look_ahead_equal_those_both_ways_in_one_sort(days, capsys):
    fills = [lambda d, **k: W.interpolate(d, "time", direction="both", value="rh", out="rh", **k),
             lambda d, **k: W.interpolate(d, limit=2, value="rh", **k),
             lambda d, **k: W.interpolate_all(d, {"rh": "a", "tavg": "b"}, **k),
             lambda d, **k: nearest_within(d, 3, value="d", out="n", **k),
             lambda d, **k: I.temperature_relation_fill(d, **k),
             lambda d, **k: I.humidity_from_dewpoint(d, **k),
             lambda d, **k: I.daylight_cap(d, 5.5, value="rh", **k)]
    for fill in fills:
        same(fill(days), fill(days, look_ahead=True))
        capsys.readouterr()
        fill(days, look_ahead=True).explain()
        assert capsys.readouterr().out.count("Sort [") == 1


def test_directions_take_one_sort_for_all_means(days, capsys):
    capsys.readouterr()
    I.wind_direction_fill(days, value="d", look_ahead=True).explain()
    assert capsys.readouterr().out.count("Sort [") == 2


def test_few_compass_fills_move_no_rows(days, capsys):
    rows = days.withColumn("cardinal", F.when(F.dayofmonth("ds") > 3, "N")).withColumn(
        "direction", F.lit(None).cast("double"))
    filled = I.cardinal_clean(rows)
    assert filled.where("filled IS NULL").count() == 0
    capsys.readouterr()
    filled.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_silhouettes_equal_those_of_the_library(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    rows = spark.createDataFrame(points.tolist(), "_x0 double, _x1 double")
    models = {2: [[0.5, 0.0], [1.0, 4.0]], 3: [[0.0, 0.0], [3.0, 1.0], [1.0, 4.0]]}
    got = L._silhouettes(rows, ["_x0", "_x1"], models | {4: [*models[3], [90.0, 90.0]]})
    assert set(got) == {2, 3}  # an empty cluster has none
    packed = VectorAssembler(inputCols=["_x0", "_x1"], outputCol="features").transform(rows)
    for k, centers in models.items():
        placed = packed.withColumn("prediction", L._nearest(["_x0", "_x1"], centers).cast("double"))
        assert got[k] == pytest.approx(ClusteringEvaluator().evaluate(placed), abs=1e-9)


def test_a_forest_does_not_change_with_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((3000, 3))
    wet = (x[:, 0] + 0.5 * x[:, 1] > 0.8).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(w)) for i, (v, w) in enumerate(zip(x, wet))],
                                 "id long, a double, b double, c double, wet int")
    make = lambda df: forest.grown(df, list("abc"), F.col("wet"), F.xxhash64("id"), trees=12, depth=4)
    one = make(rows.repartition(3))
    monkeypatch.setattr(forest, "CHUNK", 100)
    monkeypatch.setattr(forest, "MOST_NODES", 5)
    parts = make(rows.repartition(7))
    assert sum(one.importances) == pytest.approx(1) and one.importances[0] > one.importances[2]
    right = one.transform(rows).where("rain = wet").count()
    assert right > 2700
    assert abs(parts.transform(rows).where("rain = wet").count() - right) < 100


def test_leaves_of_a_forest_are_shares_of_their_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 4), int(i % 4 > 1)) for i in range(400)], "id long, a double, wet int")
    grown = forest.grown(rows, ["a"], F.col("wet"), F.xxhash64("id"), trees=3, depth=5)
    assert all(len(left) == 3 for left in grown.nodes.left)  # one split is enough: its leaves are pure
    assert all(list(w[1:]) == [0.0, 1.0] for w in grown.nodes.wet)
    assert grown.transform(rows).where("rain <> wet").count() == 0
    alone = forest.grown(rows.where("wet = 1"), ["a"], F.col("wet"), F.xxhash64("id"), trees=3, depth=5)
    assert alone.transform(rows).where("rain <> 1").count() == 0 and alone.importances == [0.0]


def test_clusters_of_all_sizes_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    middles = np.array([[0.0, 0.0], [5.0, 0.0], [0.0, 5.0], [5.0, 5.0]])
    points = np.concatenate([rng.normal(c, 0.1, (80, 2)) for c in middles])
    rows = spark.createDataFrame(points.tolist(), "a double, b double").repartition(3)
    passes, plain = [], clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda *a: passes.append(1) or plain(*a))
    found = clusters.centers_of(rows, [2, 3, 4])
    assert len(passes) <= 6 + clusters.STEPS
    assert {k: len(c) for k, c in found.items()} == {2: 2, 3: 3, 4: 4}
    assert sorted(np.round(found[4]).tolist()) == sorted(middles.tolist())
    for k, c in found.items():  # every center is the mean of the points nearest to it
        own = ((points[:, None] - np.array(c)) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose(c, [points[own == j].mean(axis=0) for j in range(k)], atol=1e-3)
    few = spark.createDataFrame([(1.0, 1.0)] * 9 + [(2.0, 2.0)] * 9, "a double, b double")
    assert sorted(clusters.centers_of(few, [5])[5]) == [[1.0, 1.0], [2.0, 2.0]]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    from raingrid.sources import lines

    for i in range(300):
        (tmp_path / f"station=s{i}").mkdir()
        (tmp_path / f"station=s{i}" / "a.csv").write_text("Date,TN\n2020-01-01,20\n")
    before, tracker = spark.conf.get(lines.LISTING), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    rows = lines.read_lines(spark, f"file:{tmp_path}")
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing")
             for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(lines.LISTING) == before and rows.count() == 600
    assert tasks and max(tasks) <= max(32, 4 * spark.sparkContext.defaultParallelism)
