"""Small graphs take few tasks, however many partitions are set: the driver keeps something of each task."""

from folioscope.llm.common import components


def test_few_edges_make_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots = components(spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(1, 2), (5, 1)], "a long, b long"))
        assert roots.rdd.getNumPartitions() <= 12
        assert {r.node: r.root for r in roots.collect()} == {i: 0 if i < 6 else i // 2 * 2 for i in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
