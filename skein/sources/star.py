"""The star schema read as a graph: views only, nothing is copied.

Regions are subdomains, nations bounded contexts, customers concepts, suppliers services, brands
capabilities; orders make flows of their lines, events the mutation log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, lifecycle_status, confidence, segment."""
    t = lambda n: table(spark, sf_dir, n)
    state = lambda k: F.element_at(F.array(*map(F.lit, ["active", "draft", "deprecated", "retired"])), (F.col(k) % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    part = lambda df, k, prefix, kind, name, segment: df.select(_key(prefix, k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), state(k).alias("lifecycle_status"), (F.col(k) % 101 / 100).cast("double").alias("confidence"), segment.alias("segment"))
    rows = part(t("region"), "r_regionkey", "r", "Subdomain", "r_name", none)
    rows = rows.unionByName(part(t("nation"), "n_nationkey", "n", "BoundedContext", "n_name", none))
    rows = rows.unionByName(part(t("customer"), "c_custkey", "c", "DomainConcept", "c_name", F.col("c_mktsegment")))
    return rows.unionByName(part(t("supplier"), "s_suppkey", "s", "Service", "s_name", none))


NODES_SQL = """nodes AS (
  SELECT id, type, name, CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' WHEN 2 THEN 'deprecated' ELSE 'retired' END AS lifecycle_status, CAST(k % 101 AS DOUBLE) / 100 AS confidence, segment FROM (
    SELECT 'r' || r_regionkey AS id, 'Subdomain' AS type, r_name AS name, CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS segment FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'BoundedContext', n_name, n_nationkey, NULL FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'DomainConcept', c_name, c_custkey, c_mktsegment FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'Service', s_name, s_suppkey, NULL FROM supplier) x)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, supplier pairs that trade, once each."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_suppkey").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, source_id, target_id: belongsTo between places and their members, consumes from customers to suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    part = lambda df, source, target, kind: df.select(F.concat(F.lit("e-"), source, F.lit("-"), target).alias("id"), F.lit(kind).alias("type"), source.alias("source_id"), target.alias("target_id"))
    rows = part(t("nation"), _key("n", "n_nationkey"), _key("r", "n_regionkey"), "belongsTo")
    rows = rows.unionByName(part(t("customer"), _key("c", "c_custkey"), _key("n", "c_nationkey"), "belongsTo"))
    rows = rows.unionByName(part(t("supplier"), _key("s", "s_suppkey"), _key("n", "s_nationkey"), "belongsTo"))
    return rows.unionByName(part(trades(spark, sf_dir), _key("c", "o_custkey"), _key("s", "l_suppkey"), "consumes"))


EDGES_SQL = """edges AS (
  SELECT 'e-' || s || '-' || t AS id, type, s AS source_id, t AS target_id FROM (
    SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS t, 'belongsTo' AS type FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'belongsTo' FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'belongsTo' FROM supplier
    UNION ALL SELECT 'c' || o_custkey, 's' || l_suppkey, 'consumes' FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)) x)"""


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, supplier, nation, balance, price of what suppliers ship, summed."""
    lines, parts, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    summed = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("p_brand", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return summed.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("brand"), F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "lines")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities: one for each brand, id and name."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_brand")).alias("id"), F.col("p_brand").alias("name")).distinct()


def brand_edges(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """implements from suppliers with a positive balance to all brands they ship, fulfils from suppliers to all brands they ship.

    These realise every brand of the star schema, so gaps have nothing to find. ``thin`` leaves some: implements takes
    balances over 9990 and more than one line, fulfils the brand that a supplier ships most of.
    """
    rows = shipped(spark, sf_dir)
    most = rows.groupBy("supplier").agg(F.max(F.struct("lines", "brand")).alias("_m")).select("supplier", F.col("_m.brand").alias("brand"))
    able, serving = (rows.where("balance > 9990 and lines > 1"), most) if thin else (rows.where("balance > 0"), rows)
    part = lambda df, kind, letter: df.select(F.concat(F.lit(letter), F.col("supplier").cast("string"), F.lit("-"), F.col("brand")).alias("id"), F.lit(kind).alias("type"), F.concat(F.lit("s"), F.col("supplier").cast("string")).alias("source_id"), F.concat(F.lit("b"), F.col("brand")).alias("target_id"))
    return part(able, "implements", "i").unionByName(part(serving, "fulfils", "f"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of nations on brands, banded by their share of the brand's lines: id, capability, target_id, coverage, percentage, gaps."""
    rows = shipped(spark, sf_dir).groupBy("brand", "nation").agg(F.sum("lines").alias("lines"))
    whole = rows.groupBy("brand").agg(F.sum("lines").alias("whole"))
    shares = rows.join(whole, "brand").withColumn("percentage", F.floor(F.col("lines") * 1000 / F.col("whole")) / 10)
    cover = F.when(F.col("percentage") >= 9, "full").when(F.col("percentage") >= 7, "partial").otherwise("none")
    name = F.concat(F.col("brand"), F.lit("@"), F.col("nation").cast("string"))
    return shares.select(F.concat(F.lit("m-"), name).alias("id"), F.concat(F.lit("cap-"), F.col("nation").cast("string")).alias("capability"), F.concat(F.lit("b"), F.col("brand")).alias("target_id"), cover.alias("coverage"), "percentage", F.array(F.concat(F.lit("gap "), name)).alias("gaps"))


SHIPPED_SQL = """shipped AS (
  SELECT p_brand AS brand, s_suppkey AS supplier, s_nationkey AS nation, s_acctbal AS balance, count(*) AS lines
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
brands AS (SELECT DISTINCT 'b' || p_brand AS id, p_brand AS name FROM part),
brand_edges AS (
  SELECT 'i' || supplier || '-' || brand AS id, 'implements' AS type, 's' || supplier AS source_id, 'b' || brand AS target_id FROM shipped WHERE balance > 0
  UNION ALL SELECT 'f' || supplier || '-' || brand, 'fulfils', 's' || supplier, 'b' || brand FROM shipped),
thin_edges AS (
  SELECT 'i' || supplier || '-' || brand AS id, 'implements' AS type, 's' || supplier AS source_id, 'b' || brand AS target_id FROM shipped WHERE balance > 9990 AND lines > 1
  UNION ALL SELECT 'f' || supplier || '-' || brand, 'fulfils', 's' || supplier, 'b' || brand FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY lines DESC, brand DESC) AS k FROM shipped) y WHERE k = 1),
shares AS (SELECT brand, nation, floor(sum(lines) * 1000.0 / sum(sum(lines)) OVER (PARTITION BY brand)) / 10 AS percentage FROM shipped GROUP BY brand, nation),
mappings AS (
  SELECT 'm-' || brand || '@' || nation AS id, 'cap-' || nation AS capability, 'b' || brand AS target_id,
    CASE WHEN percentage >= 9 THEN 'full' WHEN percentage >= 7 THEN 'partial' ELSE 'none' END AS coverage,
    CAST(percentage AS DOUBLE) AS percentage FROM shares)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log: entity_id, ts, seq, state (null for errors), event_type, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"), "event_type", "value", "props")
