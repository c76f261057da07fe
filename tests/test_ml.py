import os

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from revlens.operators import forest, ml
from revlens.plans import ml as mlplan

from paths import SF_SMALL


def test_feature_frame_has_no_nulls_and_target(spark):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL))
    assert f.count() > 0
    row = f.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in ml.FEATURE_COLS]).first()
    assert all(v == 0 for v in row)
    assert "features" in f.columns and ml.TARGET in f.columns


def test_hash_split_is_deterministic_and_disjoint(spark):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL))
    tr, te = ml.hash_split(f, "Place")
    tr2, te2 = ml.hash_split(f.repartition(5), "Place")
    a = {r.Place for r in te.collect()}
    assert a == {r.Place for r in te2.collect()}
    assert a.isdisjoint({r.Place for r in tr.collect()})
    assert tr.count() + te.count() == f.count()


def test_forest_metrics_importances_and_persistence(spark, tmp_dir):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL))
    tr, te = ml.hash_split(f, "Place")
    model = ml.train_forest(tr, num_trees=10)
    m = ml.regression_metrics(model.transform(te)).first()
    assert m.mae >= 0 and m.rmse >= m.mae and m.r2 <= 1.0
    imp = ml.feature_importances(spark, model).collect()
    assert len(imp) == len(ml.FEATURE_COLS) and abs(sum(r.share for r in imp) - 1.0) < 1e-5
    preds = ml.test_predictions(model, te, "Place").collect()
    assert all(r.predicted_review_count >= 0 for r in preds)
    ranked = ml.all_predictions(model, f, "Place").collect()
    assert min(r.popularity_rank for r in ranked) == 1
    path = os.path.join(tmp_dir, "model")
    ml.save_model(model, path)
    again = RandomForestRegressionModel.load(path)
    assert again.getNumTrees == 10


def test_forest_table_scores_as_the_model_does(spark, tmp_dir):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL))
    model = ml.train_forest(f, num_trees=7)
    path = os.path.join(tmp_dir, "model")
    ml.save_model(model, path)
    nodes = forest.forest_nodes(spark, path)
    n = len(ml.FEATURE_COLS)
    leaves = forest.forest_leaves(nodes, n, ml.FOREST["maxDepth"]).cache()
    assert leaves.count() == nodes.filter("left < 0").count()
    cuts, order = forest.forest_thresholds(nodes, n)
    # places, and made-up rows that lie on thresholds
    edge = [(f"edge{i}", *[(c[(i * 7 + j) % len(c)] if c else 0.0) for j, c in enumerate(cuts)]) for i in range(40)]
    rows = f.select("Place", *ml.FEATURE_COLS).unionByName(spark.createDataFrame(edge, ["Place", *ml.FEATURE_COLS]))
    own = {r.Place: r.prediction for r in model.transform(VectorAssembler(inputCols=ml.FEATURE_COLS, outputCol="features").transform(rows)).collect()}
    nulls = spark.createDataFrame([("null", *[None] * n)], rows.schema)
    got = forest.score_forest(rows.unionByName(nulls), "Place", ml.FEATURE_COLS, leaves, cuts, order).collect()
    assert {r.Place for r in got} == set(own) and all(r.n_trees == 7 for r in got)
    assert all(abs(r.prediction - own[r.Place]) < 1e-9 for r in got)
    empty = forest.score_forest(rows.limit(0), "Place", ml.FEATURE_COLS, leaves, cuts, order)
    assert empty.count() == 0


def test_training_partitions_depend_on_rows_and_not_on_their_files(spark):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL)).localCheckpoint()
    few, many = (ml._dealt(f.repartition(n, "review_count"), 200).select(ml.TARGET).rdd.glom().collect() for n in (1, 23))
    assert few == many and sum(map(len, few)) == f.count()  # rows are drawn for the trees by their place
    # training runs in as many partitions as there are cores, more only for many rows
    cores = spark.sparkContext.defaultParallelism
    assert len(few) == cores
    assert ml._dealt(f, ml.PART_ROWS * cores + 1).rdd.getNumPartitions() == 2 * cores


def test_boxes_of_the_forest_are_never_broadcast(spark, tmp_dir):
    f = ml.engineer_features(mlplan.place_features(spark, SF_SMALL)).localCheckpoint()
    path = os.path.join(tmp_dir, "model")
    ml.save_model(ml.train_forest(f, num_trees=2), path)
    nodes = forest.forest_nodes(spark, path)
    n = len(ml.FEATURE_COLS)
    leaves = forest.forest_leaves(nodes, n, ml.FOREST["maxDepth"]).localCheckpoint()
    plan = forest.score_forest(f, "Place", ml.FEATURE_COLS, leaves, *forest.forest_thresholds(nodes, n))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
