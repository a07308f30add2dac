"""Intermediate tables: where they lie, and when they go."""

import os
from types import SimpleNamespace

import pytest

from octavo import storage


def folders(spark):
    at = storage.shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/octavo"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_scratch(spark):
    """What is kept inside goes at the end, but for what is kept for outside; an error changes nothing of that."""
    before = folders(spark)
    with storage.scratch(spark):
        outer = None
        with storage.scratch(spark):
            inner = storage.keep(spark.range(3).toDF("a"), "inner")
            outer = storage.keep(inner.selectExpr("a + 1 as a"), "outer", outer=True)
        assert sorted(r.a for r in outer.collect()) == [1, 2, 3] and len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        storage.keep(spark.range(1), "lost")
        1 / 0  # noqa: B018
    assert folders(spark) == before
    kept = storage.keep(spark.range(2), "result")
    assert kept.count() == 2 and len(folders(spark) - before) == 1
    assert storage.cleared(spark) >= 1 and not folders(spark) - before


def test_heap_is_given_back(spark):
    """Tasks collect garbage where they run, and the driver does; each stage of the pipeline begins with that."""
    import corpus_pipeline

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = beans()
    storage.give_back(spark, tasks=2)
    assert beans() - before >= 3

    class Begun(Exception):
        pass

    def begun(_):
        raise Begun

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "give_back", begun)
        for _, stage in corpus_pipeline.STAGES:
            with pytest.raises(Begun):
                stage(spark, spark.range(1), "/nowhere")


def test_settings_are_put_back(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 12345)
    try:
        storage.keep(spark.range(1), "one")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "12345"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize(("master", "fine"), [("local[4]", True), ("local-cluster[2,1,512]", False), ("yarn", False), ("spark://host:7077", False)])
def test_no_shared_folder(master, fine):
    """Without a shared folder only local mode works: executors of a cluster would not see each other's files."""
    at: list[str] = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: at[-1] if at else None, setCheckpointDir=at.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    if fine:
        assert storage.shared_dir(session).startswith("file://")
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session)


def test_sized(spark):
    few, many = storage.sized(spark.range(5), limit=10), storage.sized(spark.range(50), limit=10)
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(few) and not hint(many)
