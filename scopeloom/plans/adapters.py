"""Graphs made from the synthetic tables, on which the operators' answers have a closed form."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import content_tag
from ..schema import NODES_DDL, ROOT, SYMBOLS, singletons


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(file: Column, local_id: Column) -> Column:
    return F.concat(file, F.lit("("), local_id.cast("string"), F.lit(")"))


def nodes_of(df: DataFrame, file: Column, local_id: Column, kind: str, symbol: Column | None = None, flag: bool = False) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], NODES_DDL).schema
    given = {
        "nid": node_id(file, local_id), "file": file, "local_id": local_id.cast("int"), "kind": F.lit(kind), "symbol": symbol if symbol is not None else F.lit(None),
        "is_definition": F.lit(flag and kind.startswith("pop")), "is_reference": F.lit(flag and kind.startswith("push")), "is_exported": F.lit(flag and kind == "scope"), "ord": local_id.cast("bigint"),
    }
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def edges_of(df: DataFrame, source: Column, sink: Column, precedence: Column | None = None) -> DataFrame:
    return df.select(source.alias("source"), sink.alias("sink"), (precedence if precedence is not None else F.lit(0)).cast("int").alias("precedence"), F.lit(0).cast("bigint").alias("ord"), F.expr("cast(array() as array<struct<key:string,value:string>>)").alias("debug_info"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_singletons(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    return nodes.unionByName(spark.createDataFrame(singletons(), NODES_DDL))


def geo(spark: SparkSession, sf_dir: str, who: str = "customer") -> tuple[DataFrame, DataFrame]:
    """A file per region that defines it and its nations; each customer or supplier refers to its nation by way of the region."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    k = who[0]
    people = table(spark, sf_dir, who).join(nation, F.col(f"{k}_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    r, file, base = F.col("r_name"), F.concat(F.lit(f"{who}/"), F.col("n_name")), F.col(f"{k}_{'cust' if who == 'customer' else 'supp'}key") * 3
    dot = F.lit(".")
    nodes = union(
        nodes_of(region, r, F.lit(0), "pop_symbol", r, True), nodes_of(region, r, F.lit(1), "pop_symbol", dot),
        nodes_of(places, r, F.col("n_nationkey") + 10, "pop_symbol", F.col("n_name"), True),
        nodes_of(people, file, base, "push_symbol", F.col("n_name"), True), nodes_of(people, file, base + 1, "push_symbol", dot), nodes_of(people, file, base + 2, "push_symbol", r),
    )
    edges = union(
        edges_of(region, F.lit(ROOT), node_id(r, F.lit(0))), edges_of(region, node_id(r, F.lit(0)), node_id(r, F.lit(1))), edges_of(places, node_id(r, F.lit(1)), node_id(r, F.col("n_nationkey") + 10)),
        edges_of(people, node_id(file, base), node_id(file, base + 1)), edges_of(people, node_id(file, base + 1), node_id(file, base + 2)), edges_of(people, node_id(file, base + 2), F.lit(ROOT)),
    )
    return with_singletons(spark, nodes), edges


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Per customer, a scope whose edges lead to one definition per order (symbol: its priority), later orders with higher
    precedence; one reference per priority."""
    orders = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    file, p = F.concat(F.lit("c"), F.col("o_custkey")), F.col("o_orderpriority")
    who, wanted = orders.select("o_custkey").distinct(), orders.select("o_custkey", "o_orderpriority").distinct()
    ref = F.substring("o_orderpriority", 1, 1).cast("int")  # priorities start with their number
    nodes = union(nodes_of(who, file, F.lit(0), "scope"), nodes_of(wanted, file, ref, "push_symbol", p, True), nodes_of(orders, file, F.col("rank") + 10, "pop_symbol", p, True))
    edges = union(edges_of(wanted, node_id(file, ref), node_id(file, F.lit(0))), edges_of(orders, node_id(file, F.lit(0)), node_id(file, F.col("rank") + 10), F.col("rank")))
    return with_singletons(spark, nodes), edges


def alias(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References to parts; a part's definition is an alias of its brand's."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").withColumn("shard", F.concat(F.lit("parts"), F.col("p_partkey") % 16))
    brand, key = part.select("p_brand").distinct(), F.col("p_partkey")
    file, name, b = F.col("shard"), F.concat(F.lit("part"), F.col("p_partkey")), F.col("p_brand")
    nodes = union(nodes_of(part, file, key * 3, "push_symbol", name, True), nodes_of(part, file, key * 3 + 1, "pop_symbol", name, True), nodes_of(part, file, key * 3 + 2, "push_symbol", b), nodes_of(brand, b, F.lit(0), "pop_symbol", b, True))
    edges = union(edges_of(part, node_id(file, key * 3), node_id(file, key * 3 + 1)), edges_of(part, node_id(file, key * 3 + 1), node_id(file, key * 3 + 2)), edges_of(part, node_id(file, key * 3 + 2), F.lit(ROOT)), edges_of(brand, F.lit(ROOT), node_id(b, F.lit(0))))
    return with_singletons(spark, nodes), edges


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return edges_of(nation, F.col("n_nationkey").cast("string"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("string"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of files: one file per user, its content the event's properties."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u/"), F.col("user_id")).alias("file"), content_tag(F.coalesce("props", F.lit(""))).alias("tag"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"), F.col("event_id").alias("version"))


def stack_of(parts: Column, variable: int | None = None) -> Column:
    symbols = F.transform(parts, lambda x: F.struct(x.alias("symbol"), F.lit(None).alias("scopes")))
    return F.struct(symbols.alias("symbols"), F.lit(variable).cast("int").alias("variable")).cast(SYMBOLS)
