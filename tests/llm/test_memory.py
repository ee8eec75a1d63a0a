"""What the driver gives back between phases and stages."""

import random


def collections(spark):
    """Full collections of the driver's heap so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_near_dedup_gives_memory_back_between_its_phases(spark):
    import corpus_pipeline as P

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20)), "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows + [(9, *rows[0][1:])], "doc_id long, text string, lang string, source string, n_chars long")
    before = collections(spark)
    assert P.near_dedup(spark, docs, "").count() == 5
    assert collections(spark) - before >= 6
