"""Record types, fixed values, and adapters from the test tables to memories, edges and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("decision", "fact", "event", "preference", "goal")
SALIENCES = ("routine", "important", "critical")
#: Days until half of a kind's importance has gone.
HALF_LIFE = {"decision": 365.0, "fact": 90.0, "event": 14.0, "preference": 30.0, "goal": 365.0}
#: Kinds that decay by idle time instead of age.
HEBBIAN = ("preference", "decision")
#: Traversal weights of edge kinds.
EDGE_WEIGHT = {"caused_by": 5.0, "derived_from": 4.0, "supports": 3.0, "supersedes": 3.0, "before": 2.0, "after": 2.0, "relates_to": 1.0, "contradicts": 1.0}

MEMORY = "id bigint, text string, tags array<string>, kind string, salience string, agent string, user string, session string, shared_with array<string>, importance double, created_s bigint, accessed_s bigint, access_count bigint, superseded_by bigint, token_count bigint, version bigint, supersedes bigint, tag_sources array<string>, attributes map<string,struct<t:string,b:boolean,n:double,s:string,l:array<string>>>, vector array<bigint>"
EDGE = "src bigint, dst bigint, kind string, seq bigint"

#: The fixed time that queries take for now, in seconds.
AS_OF = 1748736000
_BASE = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories, their quality as importance. Each of the derived fields follows from the id."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"),
        "text",
        F.array("lang", "source").alias("tags"),
        F.element_at(F.array(*map(F.lit, KINDS)), (i % 5 + 1).cast("int")).alias("kind"),
        F.when(i % 11 == 0, "critical").when(i % 11 < 3, "important").otherwise("routine").alias("salience"),
        F.col("source").alias("agent"),
        F.when(i % 3 != 0, F.concat(F.lit("u"), i % 4)).alias("user"),
        F.when(i % 6 == 1, F.concat(F.lit("s"), i % 2)).alias("session"),
        F.when(i % 10 == 0, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>")).alias("shared_with"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("importance"),
        (F.lit(_BASE) + i * 3600).alias("created_s"),
        (F.lit(_BASE) + i * 3600 + i % 50 * 86400).alias("accessed_s"),
        (i % 13).alias("access_count"),
        F.when(i % 17 == 0, i + 1).alias("superseded_by"),
        F.greatest(F.floor(F.octet_length("text") / 4), F.lit(1)).cast("bigint").alias("token_count"),
        (1 + i % 3).alias("version"),
    )


#: The same in SQL for the comparison engine.
MEMORIES_SQL = f"""
mem AS (
  SELECT d.doc_id AS id, d.text AS text, [d.lang, d.source] AS tags,
         ['decision', 'fact', 'event', 'preference', 'goal'][d.doc_id % 5 + 1] AS kind,
         CASE WHEN d.doc_id % 11 = 0 THEN 'critical' WHEN d.doc_id % 11 < 3 THEN 'important' ELSE 'routine' END AS salience,
         d.source AS agent, CASE WHEN d.doc_id % 3 <> 0 THEN 'u' || (d.doc_id % 4) END AS usr,
         CASE WHEN d.doc_id % 6 = 1 THEN 's' || (d.doc_id % 2) END AS session,
         CASE WHEN d.doc_id % 10 = 0 THEN ['src1'] ELSE [] END AS shared_with,
         coalesce(CAST(l.quality AS DOUBLE), 0.5) AS importance,
         {_BASE} + d.doc_id * 3600 AS created_s, {_BASE} + d.doc_id * 3600 + d.doc_id % 50 * 86400 AS accessed_s,
         d.doc_id % 13 AS access_count, CASE WHEN d.doc_id % 17 = 0 THEN d.doc_id + 1 END AS superseded_by,
         greatest(CAST(floor(strlen(d.text) / 4) AS BIGINT), 1) AS token_count, 1 + d.doc_id % 3 AS version
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed graph over customers, suppliers, nations and regions, from their keys."""
    t = lambda name: table(spark, sf_dir, name)
    parts = (
        t("customer").select((F.lit(1000000) + F.col("c_custkey")).alias("src"), (F.lit(3000000) + F.col("c_nationkey")).cast("bigint").alias("dst"), F.lit("derived_from").alias("kind")),
        t("supplier").select((F.lit(2000000) + F.col("s_suppkey")).alias("src"), (F.lit(3000000) + F.col("s_nationkey")).cast("bigint").alias("dst"), F.lit("supports").alias("kind")),
        t("nation").select((F.lit(3000000) + F.col("n_nationkey")).cast("bigint").alias("src"), (F.lit(4000000) + F.col("n_regionkey")).cast("bigint").alias("dst"), F.lit("relates_to").alias("kind")),
        t("customer").filter("c_custkey > 1").select((F.lit(1000000) + F.col("c_custkey")).alias("src"), (F.lit(1000000) + F.floor(F.col("c_custkey") / 2)).cast("bigint").alias("dst"), F.lit("caused_by").alias("kind")),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("seq", F.col("src") * 7 % 1000003)


EDGES_SQL = """
edg AS (
  SELECT *, src * 7 % 1000003 AS seq FROM (
    SELECT 1000000 + c_custkey AS src, CAST(3000000 + c_nationkey AS BIGINT) AS dst, 'derived_from' AS kind FROM customer
    UNION ALL SELECT 2000000 + s_suppkey, CAST(3000000 + s_nationkey AS BIGINT), 'supports' FROM supplier
    UNION ALL SELECT CAST(3000000 + n_nationkey AS BIGINT), CAST(4000000 + n_regionkey AS BIGINT), 'relates_to' FROM nation
    UNION ALL SELECT 1000000 + c_custkey, 1000000 + c_custkey // 2, 'caused_by' FROM customer WHERE c_custkey > 1))
"""
