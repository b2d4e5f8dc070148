from graphloom.llm import components


def test_files_follow_the_links(spark, monkeypatch):
    """Few links take one file a round, more links more; the components are the same."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 10 != 9], "a long, b long")
        want = {i: i - i % 10 for i in range(200)}
        for rows, files in ((100_000, 1), (100, 4)):
            monkeypatch.setattr(components, "ROWS", rows, raising=False)
            got = components.components(links)
            assert len(got.inputFiles()) == files and {r.id: r.comp for r in got.collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
