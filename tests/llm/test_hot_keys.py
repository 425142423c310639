"""A node with very many edges: its partition is split, and components stay right."""

from pyspark.sql import functions as F

from matchweave.llm import components


def test_the_join_of_a_hot_node_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(50_000, 52_000).selectExpr("id as u", "id + 1 as v")).repartition(16)
        spread = components._large_star(star)
        spread.collect()
        assert "skew=true" in spread._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    edges = spark.range(1, 3001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(5000, 5040).selectExpr("id as u", "id + 1 as v"))
    got = dict(map(tuple, components.components(edges).collect()))
    assert len(got) == 3001 + 41 and all(c == (0 if n < 5000 else 5000) for n, c in got.items())
