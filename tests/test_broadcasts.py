"""Tables that pack well are not broadcast for their small files."""

from pyspark.sql import functions as F

from scopeloom import session


def test_large_tables_of_small_files_join_by_shuffle(spark):
    s = session.Scratch(spark, "packed")
    make = lambda n: spark.range(n).select(F.col("id"), F.concat(F.lit("parts("), F.col("id"), F.lit(")")).alias("nid"))
    plan = lambda df: spark.range(10).join(df.where("id >= 0").select("id"), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(s.table(make(300_000), "before"))  # its files have under 10 MB
    assert "BroadcastHashJoin" not in plan(s.joined(make(300_000), "large"))
    assert "BroadcastHashJoin" in plan(s.joined(make(100), "small"))
