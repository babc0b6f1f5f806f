from gridloom.operators import raster as ops
from gridloom.sources import views


def _cells(spark):
    return spark.createDataFrame([(2024, 0, 0, 3), (2024, 0, 1, 81), (2024, 1, 0, 5), (2024, 1, 1, 3)], "year int, iy long, ix long, code int")


def _mask(spark):
    return spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.9), (1, 0, float("nan")), (1, 1, 0.49)], "iy long, ix long, p double")


def test_threshold_counts_half_and_not_nan(spark):
    found = {(r.iy, r.ix): r.field for r in ops.with_field(_cells(spark), _mask(spark)).collect()}
    assert found == {(0, 0): True, (0, 1): True, (1, 0): False, (1, 1): False}


def test_disagreement_classes(spark):
    kinds = views.classes(spark)  # 5 is Water, 3 a crop
    cells = ops.drop_codes(_cells(spark), kinds, False)
    found = {(r.iy, r.ix): r.kind for r in ops.disagreement(ops.with_field(cells, _mask(spark)), kinds).collect()}
    assert found == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_no_class_two_under_a_clip(spark):
    kinds = views.classes(spark)
    cells = ops.clip(ops.with_field(ops.drop_codes(_cells(spark), kinds, False), _mask(spark)))
    assert not ops.disagreement(cells, kinds).filter("kind = 2").count()


def test_majority_ties_go_to_the_smaller_code(spark):
    rows = spark.createDataFrame([(1, 0, 0, 9), (1, 0, 1, 4)], "year int, iy long, ix long, code int")
    assert ops.majority_pyramid(rows, 2).head().code == 4
