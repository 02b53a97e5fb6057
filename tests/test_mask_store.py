"""Stored masks: pruned reads, masks replaced one by one."""

from pyspark.sql import functions as F

from cellscore.sources import mask_store as ms


def files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.length()))


def test_some_rows_read_their_bands_only(spark, tmp_path):
    h, path = 20_038, str(tmp_path / "m")
    rle = spark.range(h).select(F.lit("big").alias("mask_id"), F.col("id").cast("int").alias("r"), (F.col("id") % 7).cast("int").alias("c0"), F.lit(40_000).alias("c1"))
    shapes = spark.createDataFrame([("big", h, 40_076), ("sea", 512, 1024)], "mask_id string, h int, w int")
    ms.write_masks(rle, shapes, path)
    got = ms.read_runs(spark, path, "big", (5000, 5099))
    assert sorted(r.r for r in got.collect()) == list(range(5000, 5100)) and files_read(got) == 1
    assert files_read(ms.read_runs(spark, path, "big", (5000, 5200))) == 2  # rows of two bands
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mask_id" in plan and "band" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(r,5000)" in plan
    assert ms.read_runs(spark, path).count() == h and ms.read_runs(spark, path, "sea").collect() == []
    assert {(r.mask_id, r.h, r.w) for r in ms.stored_masks(spark, path).collect()} == {("big", h, 40_076), ("sea", 512, 1024)}


def test_a_mask_is_replaced_whole_and_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    shapes = spark.createDataFrame([("a", 10, 8), ("b", 10, 8)], "mask_id string, h int, w int")
    rows = lambda *x: spark.createDataFrame(list(x), "mask_id string, r int, c0 int, c1 int")
    ms.write_masks(rows(("a", 0, 1, 2), ("a", 9, 0, 7), ("b", 4, 4, 4)), shapes, path, band=4)
    ms.write_masks(rows(("a", 1, 3, 3)), shapes.where("mask_id = 'a'"), path, band=4)
    assert sorted(map(tuple, ms.read_runs(spark, path, band=4).collect())) == [("a", 1, 3, 3), ("b", 4, 4, 4)]
    assert sorted(map(tuple, ms.land_rows(spark, path, "b", (0, 4), band=4).collect())) == [("b", 4, 4)]
