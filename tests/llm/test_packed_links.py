"""Small link tables are not dealt over as many files as there are shuffle partitions."""

from segno.llm import components


def test_links_between_rounds_fill_few_files(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("211", "false")):
            spark.conf.set(n, v)
        edges = spark.range(1, 600).selectExpr("id AS a", "id - id % 3 AS b")
        got = components.components(edges)
        assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {x.node: x.component for x in got.collect()} == {i: i - i % 3 for i in range(600)}
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
