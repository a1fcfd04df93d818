from strandline.llm.common import scratch_table


def test_garbage_of_a_phase_is_collected(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in whole)
    scratch_table(spark.range(3).toDF("a"), "few")
    assert sum(b.getCollectionCount() for b in whole) > before
