"""A table is one small file; what is computed for its rows is dealt to as many tasks as a shuffle has."""

from conftest import DATA

from chronoplate.plans import area_queries, flat_queries, sampler_queries, source_queries, text_queries


def tasks(df):
    return df.rdd.getNumPartitions()


def test_boxes_are_dealt(spark):
    assert tasks(flat_queries.boxes(spark, DATA)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_roots_of_extents_are_dealt(spark):
    for scheme in flat_queries._SCHEMES:
        assert tasks(flat_queries._kept(spark, DATA, scheme)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_extents_after_splits_are_dealt(spark):
    both = flat_queries._extents(spark, DATA, 5)
    assert tasks(both) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rings_are_dealt(spark):
    assert tasks(flat_queries.rings(spark, DATA)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_members_are_written_by_all_tasks(spark):
    rows = source_queries.member_files(spark, DATA)
    assert len(rows.inputFiles()) > 1


def test_documents_are_exported_once(spark):
    rows = sampler_queries.experiment_export(spark, DATA)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert tasks(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_experiments_are_dealt(spark):
    assert tasks(sampler_queries.experiment_import(spark, DATA)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_loaded_items_are_dealt(spark):
    assert tasks(text_queries.loaded_items(spark, DATA)) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_polygons_of_triangles_are_dealt(spark):
    plan = area_queries.triangles(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
