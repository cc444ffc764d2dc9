"""The driver's test tables as documents, passages, graph and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import geometry as G
from quillstrata.functions import ids
from quillstrata.functions.text import entity_key, strip
from quillstrata.schemas import IMAGE, TABLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(docs: DataFrame) -> DataFrame:
    """A line is an element: a short first line of several is a heading, cells parted by bars a table's text, dashes and stars list items."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: strip(x) != "")
    rows = docs.select("doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("order", "text"))
    kind = (
        F.when((F.col("order") == 0) & (F.col("n") > 1) & (F.length("text") <= 80), "heading").when(F.contains(F.col("text"), F.lit(" | ")), "table")
        .when(F.col("text").startswith("- ") | F.col("text").startswith("* "), "list_item").otherwise("paragraph")
    )
    return rows.select(
        "doc_id", ids.element_id(F.lit(1), F.col("order")).alias("element_id"), "order", F.lit(1).alias("page_number"), kind.alias("type"), F.when(kind == "heading", 1).alias("level"),
        F.lit(None).cast("string").alias("parent_id"), G.line_box(F.col("order"), F.col("order") + 1).alias("bbox"), "text", F.lit(None).cast(TABLE).alias("table"), F.lit(None).cast(IMAGE).alias("image"), F.create_map().cast("map<string,string>").alias("attrs"),
    )


def passages(docs: DataFrame) -> DataFrame:
    """gid, doc_id, element_id, page_number, text of the elements with text."""
    return elements(docs).select(ids.global_id(F.col("doc_id").cast("string"), F.col("element_id")).alias("gid"), "doc_id", "element_id", "page_number", strip(F.col("text")).alias("text"))


def questions(benchmark: DataFrame) -> DataFrame:
    """query_id, text: each item's whole text."""
    return benchmark.select(F.col("item_id").alias("query_id"), "text")


def entity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, name, type, aliases."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    one = lambda df, rank, key, name, kind: df.select(F.struct(F.lit(rank).alias("t"), F.col(key).cast("long").alias("k")).alias("seq"), name.alias("name"), F.lit(kind).alias("type"), none.alias("aliases"))
    rows = (
        one(t("region"), 0, "r_regionkey", F.col("r_name"), "Location").union(one(t("nation"), 1, "n_nationkey", F.col("n_name"), "Location")).union(one(t("customer"), 2, "c_custkey", F.col("c_name"), "Organization"))
        .union(one(t("supplier"), 3, "s_suppkey", F.col("s_name"), "Team")).union(one(t("part"), 4, "p_partkey", F.concat(F.lit("part "), F.col("p_partkey")), "Product")).union(one(t("orders"), 5, "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")), "Document"))
    )
    return rows.withColumn("key", entity_key(F.col("name"), F.col("type")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, name, type, aliases, seq: the entity log holds no key twice but for repeated names, of which the first stands."""
    log = entity_log(spark, sf_dir)
    return log.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.array().cast("array<string>").alias("aliases"), F.min("seq").alias("seq"))


def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, source_key, relation, target_key, doc_id (the table), element_ids, evidence, confidence."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    owned = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    used = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    location = lambda c: entity_key(c, F.lit("Location"))
    order, part = entity_key(F.concat(F.lit("order "), F.col("k1")), F.lit("Document")), entity_key(F.concat(F.lit("part "), F.col("k2")), F.lit("Product"))

    def one(df: DataFrame, rank: int, doc: str, k1, k2, source, relation: str, target) -> DataFrame:
        keyed = df.withColumn("k1", k1.cast("long")).withColumn("k2", k2.cast("long"))
        return keyed.select(
            F.struct(F.lit(rank).alias("t"), "k1", "k2").alias("seq"), source.alias("source_key"), F.lit(relation).alias("relation"), target.alias("target_key"), F.lit(doc).alias("doc_id"),
            F.array(F.format_string("p1e%03d", F.col("k1"))).alias("element_ids"), F.lit("").alias("evidence"), F.lit("low").alias("confidence"),
        )

    zero = F.lit(0)
    return (
        one(nation, 0, "nation", F.col("n_nationkey"), zero, location(F.col("n_name")), "PART_OF", location(F.col("r_name")))
        .union(one(customer, 1, "customer", F.col("c_custkey"), zero, entity_key(F.col("c_name"), F.lit("Organization")), "BELONGS_TO", location(F.col("n_name"))))
        .union(one(supplier, 2, "supplier", F.col("s_suppkey"), zero, entity_key(F.col("s_name"), F.lit("Team")), "BELONGS_TO", location(F.col("n_name"))))
        .union(one(placed, 3, "orders", F.col("o_orderkey"), zero, order, "CREATED_BY", entity_key(F.col("c_name"), F.lit("Organization"))))
        .union(one(owned, 4, "partsupp", F.col("l_suppkey"), F.col("l_partkey"), entity_key(F.col("s_name"), F.lit("Team")), "OWNS", part))
        .union(one(used, 5, "lineitem", F.col("l_orderkey"), F.col("l_partkey"), order, "USES", part))
    )
