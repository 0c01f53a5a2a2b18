import gc

from veracta.llm import storage


def test_a_written_table_leaves_no_full_heap(spark, monkeypatch):
    """What the driver's heap took up for garbage is given back once a table is written."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    kept = [spark._jvm.java.nio.LongBuffer.allocate(1 << 25) for _ in range(6)]  # a quarter of a GB each
    grown = heap.totalMemory()
    assert grown > 1 << 30
    del kept
    gc.collect()
    monkeypatch.setattr(storage.relieve, "__defaults__", (0.1,))
    assert storage.materialise(spark.range(5), "few").count() == 5
    assert heap.totalMemory() < grown / 2
    assert not storage.relieve(spark, 1.0)
