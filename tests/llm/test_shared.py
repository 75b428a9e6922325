from pathlib import Path

from auditmill.llm import shared


def there(df):
    return any(Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in df.inputFiles())


def test_scratch_goes_with_its_scope(spark):
    old = shared.written(spark.range(3), "old")
    with shared.scope(spark) as kept:
        gone, stays = shared.written(spark.range(4), "a"), shared.written(spark.range(5), "b")
        kept.append(stays)
    assert stays.count() == 5 and old.count() == 3 and not there(gone)
    shared.drop(stays)
    assert not there(stays) and there(old)
    shared.drop(spark.range(1))


def test_parts_and_tasks(spark):
    assert [shared.parts_of(spark, n) for n in (0, 1, shared.PART_BYTES, shared.PART_BYTES + 1)] == [1, 1, 1, 2]
    assert shared.dealt(spark.range(10), 0, 0).rdd.getNumPartitions() == 1
    assert shared.dealt(spark.range(1000), 1000, 10**12).rdd.getNumPartitions() == 1000
    assert shared.dealt(spark.range(1000), 1000, 10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
