"""Roles that the synthetic tables play: symbols, edges, commits, histories, notes and vectors (with the SQL of each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark, d) -> DataFrame:
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws("::", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("qualified_name"),
        F.col("p_brand").alias("file_path"), F.lower("p_type").alias("kind"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"),
    )


SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_brand || '::' || replace(p_name, ' ', '_') AS qualified_name, p_brand AS file_path, lower(p_type) AS kind, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part)"

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")


def edges(spark, d) -> DataFrame:
    """Dependency edges: each line of an order depends on the next one's part; repeats count."""
    li = read(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "depends_on").otherwise("type_ref")
    target = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*_ORDER))
    return li.select(F.col("l_partkey").alias("source_id"), target.alias("target_id"), kind.alias("edge_kind")).filter("target_id IS NOT NULL")


def edges_sql(name: str = "edges") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS target_id, "
        f"CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'depends_on' ELSE 'type_ref' END AS edge_kind FROM lineitem) WHERE target_id IS NOT NULL)"
    )


def file_edges(spark, d, old: bool = False) -> DataFrame:
    """Edges that stay inside a file: a graph of many components, with cycles and orphans."""
    f = symbols(spark, d)
    a, b = f.select(F.col("id").alias("source_id"), "file_path"), f.select(F.col("id").alias("target_id"), F.col("file_path").alias("_file"))
    return (old_edges if old else edges)(spark, d).join(a, "source_id").join(b, "target_id").filter("file_path = _file").drop("file_path", "_file")


def file_edges_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT e.* FROM {source} e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id WHERE a.file_path = b.file_path)"


def named_edges(spark, d) -> DataFrame:
    """Edges whose target is a name, resolved late: one in 16 names does not resolve."""
    s = symbols(spark, d).select(F.col("id").alias("target_id"), F.col("qualified_name").alias("t"), F.col("id").alias("k"))
    name = F.when(F.col("k") % 16 == 0, F.concat(F.lit("extern::"), "t")).otherwise(F.col("t"))
    return edges(spark, d).join(s, "target_id").select("source_id", name.alias("target_qualified_name"), "edge_kind")


def named_edges_sql() -> str:
    return f"{SYMBOLS}, {edges_sql('id_edges')}, edges AS (SELECT source_id, CASE WHEN s.id % 16 = 0 THEN 'extern::' || s.qualified_name ELSE s.qualified_name END AS target_qualified_name, edge_kind FROM id_edges JOIN symbols s ON s.id = target_id)"


def fingerprints(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("symbol_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"), F.to_date("ts").alias("day"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("delta_sem"), (F.col("event_type") == "error").alias("source_changed"),
        (F.col("event_type") == "click").alias("neighbor_changed"), (F.col("event_type") == "view").alias("config_changed"), F.col("event_type").alias("trigger"),
    )


FINGERPRINTS = (
    "fp AS (SELECT event_id AS id, user_id AS symbol_id, epoch_us(ts) AS ts_us, CAST(ts AS DATE) AS day, least(1.0, value / 100) AS delta_sem, event_type = 'error' AS source_changed, "
    "event_type = 'click' AS neighbor_changed, event_type = 'view' AS config_changed, event_type AS trigger FROM events)"
)


def history(spark, d) -> DataFrame:
    """Version history of each user: one row for each event, the hash being its type."""
    v = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select(F.col("user_id").alias("symbol_id"), v.cast("long").alias("version"), F.col("event_type").alias("sir_hash"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("created_us"), F.col("event_id").alias("id"), "value")


HISTORY = "history AS (SELECT user_id AS symbol_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type AS sir_hash, epoch_us(ts) AS created_us, event_id AS id, value FROM events)"


def commits(spark, d) -> DataFrame:
    """Baskets: orders are commits, the suppliers of their lines are files."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("at"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file")).distinct()
    return li.join(o, "commit")


COMMITS = "commits AS (SELECT DISTINCT l_orderkey AS commit, l_suppkey AS file, epoch_us(o_orderdate) AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("file"), "embedding")


VECTORS = "vectors AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS file, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def old_edges(spark, d) -> DataFrame:
    """Edges of the orders placed before 1997: an earlier snapshot of the graph."""
    li = read(spark, d, "lineitem").join(read(spark, d, "orders").filter("o_orderdate < TIMESTAMP_NTZ'1997-01-01 00:00:00'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    target = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*_ORDER))
    return li.select(F.col("l_partkey").alias("source_id"), target.alias("target_id")).filter("target_id IS NOT NULL")


OLD_EDGES = f"old AS (SELECT * FROM (SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS target_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')) WHERE target_id IS NOT NULL)"


def planner_symbols(spark, d) -> DataFrame:
    """Symbols of the file planner: brands are files, types are containers, and two containers of each file have a type of their own."""
    p = read(spark, d, "part")
    core = F.when(F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM"), "Core").otherwise(F.lower("p_type"))
    p = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), core.alias("container"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), "p_size")
    anchored = F.col("container").isin("Core", "promo")
    first = anchored & (F.min("id").over(W.partitionBy("file", "container")) == F.col("id"))
    p = p.withColumn("type", first)
    q = F.when(F.col("type"), F.concat_ws("::", "file", "container")).otherwise(F.concat_ws("::", "file", "container", "name"))
    kind = F.when(F.col("type"), "struct").when(anchored, "method").otherwise("function")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return p.select("file", "id", q.alias("qualified_name"), kind.alias("kind"), (F.col("p_size") == 50).alias("is_test"), F.col("container")).join(v, "id", "left")


PLANNER = (
    "p AS (SELECT p_partkey AS id, p_brand AS file, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'Core' ELSE lower(p_type) END AS container, replace(p_name, ' ', '_') AS name, p_size FROM part), "
    "t AS (SELECT *, container IN ('Core', 'promo') AND min(id) OVER (PARTITION BY file, container) = id AS typed FROM p), "
    "symbols AS (SELECT file, id, CAST(id AS VARCHAR) AS node, CASE WHEN typed THEN file || '::' || container ELSE file || '::' || container || '::' || name END AS qualified_name, "
    "CASE WHEN typed THEN file ELSE file || '::' || container END AS stem, CASE WHEN typed THEN 'struct' WHEN container IN ('Core', 'promo') THEN 'method' ELSE 'function' END AS kind FROM t WHERE p_size <> 50), "
    "types AS (SELECT file, qualified_name FROM symbols WHERE kind = 'struct'), "
    "groups AS (SELECT s.*, CASE WHEN y.qualified_name IS NULL THEN node ELSE min(node) OVER (PARTITION BY s.file, y.qualified_name) END AS rep FROM symbols s LEFT JOIN types y ON y.file = s.file AND y.qualified_name IN (s.stem, CASE s.kind WHEN 'struct' THEN s.qualified_name END))"
)
