"""Journals made of orders, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans import journal

from .stand_ins import read, rounded


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A take for each order line: sessions are customers' nations, with three microphones and four sources."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 40).alias("session"), F.concat(F.lit("t"), F.col("o_orderkey") % 997).alias("take_id"), (F.col("o_orderkey") % 5).alias("source_id"),
        (F.col("o_orderkey") % 4).alias("microphone_id"), (F.col("o_orderkey") % 3).alias("repeat_index"), F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_orderkey") % 1009).alias("file"),
    )


def journal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each kind of issue the journals have."""
    t = _takes(spark, sf_dir)
    s = t.select("session").distinct().withColumn("repeats", F.lit(2))
    mics = s.select("session", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("microphone_id"))
    sources = s.select("session", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("source_id"))
    return journal.take_issues(t, mics, sources, s).groupBy("session", "issue").agg(F.count("*").alias("n"))


def selection_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _takes(spark, sf_dir).dropDuplicates(["session", "take_id"])
    t = t.withColumns({"source_id": F.substring("take_id", 2, 9).cast("int") % 5, "microphone_id": F.substring("take_id", 2, 9).cast("int") % 4})
    chosen = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("session"), F.concat(F.lit("t"), F.col("o_orderkey") % 1000).alias("take_id"))
    return journal.selection_issues(chosen, t).groupBy("session", "issue").agg(F.count("*").alias("n"))


def checkpoint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    takes = n.select(F.col("n_regionkey").alias("session"), F.col("n_name").alias("take_id"))
    c = takes.where("take_id <> 'NATION_7'").groupBy("session").agg(F.collect_list("take_id").alias("committed"))
    c = c.withColumns({"phase": F.when(F.col("session") == 1, "sweeps").otherwise("complete"), "status": F.lit("raw_complete")})
    return journal.checkpoint_issues(c, takes)


def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inputs: some gone, some new, some edited since they were frozen."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id"), F.sha2("text", 256).alias("sha256"), F.sha2(F.concat("text", F.lit(".")), 256).alias("edited"))
    now = d.where("doc_id % 50 <> 3").select("path", F.when(F.col("doc_id") % 50 == 4, F.col("edited")).otherwise(F.col("sha256")).alias("sha256"))
    return journal.snapshot_issues(d.where("doc_id % 50 <> 5").select("path", "sha256"), now)


def bench_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    lags = F.create_map(F.concat(F.col("s_suppkey") * 100, F.when(F.col("s_suppkey") % 4 == 0, "k").otherwise("")), F.col("s_acctbal"), F.lit(" 48000 "), F.lit(213.0))
    return journal.bench_lags(s.select("s_suppkey", lags.alias("lags")), "s_suppkey", "lags").withColumn("rate_hz", F.coalesce("rate_hz", F.lit(-1)))


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("o"), F.col("l_quantity").alias("direct"), (F.col("l_discount") * 10).alias("event"))  # noqa: E741
    found = journal.event_levels(l, ["l_orderkey"], "o", "direct", "event")
    return rounded(found.select("l_orderkey", F.size("levels_db").alias("n"), F.aggregate("levels_db", F.lit(0.0), lambda s, x: s + x).alias("total_db")), "total_db", digits=4)


def gathered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("source_id"), (F.col("l_suppkey") % 10).alias("microphone_id"), (F.col("l_discount") * 1000).alias("low_hz"), (F.col("l_quantity") * 100 + 60).alias("high_hz"), F.col("l_tax").alias("bound_us"))  # noqa: E741
    return rounded(journal.gathered(l, ["source_id"], 10), "low_hz", "high_hz", "bound_us")


def restored_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' missing balances from a sidecar, some of whose rows are of another version or file, and some there twice."""
    c = read(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("quality"))
    side = c.select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") + 1).alias("quality"), (F.col("c_custkey") % 3).alias("version"), F.when(F.col("c_custkey") % 5 == 0, "other").otherwise("this").alias("sha256"))
    side = side.unionByName(side.where("c_custkey % 28 = 1").withColumn("quality", F.col("quality") + 1)).unionByName(side.where("c_custkey % 28 = 7"))
    return rounded(journal.restored(rows, side, ["c_custkey", "segment"], ["quality"], F.lit("this")).select("c_custkey", "quality"), "quality", digits=2)


_T = """WITH t AS (SELECT o_custkey % 40 AS session, 't' || (o_orderkey % 997) AS take_id, o_orderkey % 5 AS source_id, o_orderkey % 4 AS microphone_id, o_orderkey % 3 AS repeat_index, lower(o_orderpriority || '-' || (o_orderkey % 1009)) AS file FROM orders)"""

SQL = {
    "journal_issues": _T + """, i AS (
  SELECT session, 'unknown_microphone' AS issue FROM t WHERE microphone_id > 2 UNION ALL SELECT session, 'repeat_range' FROM t WHERE repeat_index > 1
  UNION ALL SELECT session, 'duplicate_take_id' FROM t GROUP BY session, take_id HAVING count(*) > 1
  UNION ALL SELECT session, 'duplicate_cell' FROM t GROUP BY session, source_id, microphone_id, repeat_index HAVING count(*) > 1
  UNION ALL SELECT session, 'duplicate_file' FROM t GROUP BY session, file HAVING count(*) > 1
  UNION ALL SELECT session, 'missing_cell' FROM (SELECT session, source_id, microphone_id, repeat_index FROM (SELECT DISTINCT session FROM t), range(6) a(source_id), range(3) b(microphone_id), range(2) c(repeat_index)) w ANTI JOIN t USING (session, source_id, microphone_id, repeat_index)
) SELECT session, issue, count(*) AS n FROM i GROUP BY ALL""",
    "selection_issues": """WITH t AS (SELECT DISTINCT o_custkey % 40 AS session, o_orderkey % 997 AS k FROM orders), s AS (SELECT o_custkey % 40 AS session, o_orderkey % 1000 AS k FROM orders),
k AS (SELECT s.session, s.k FROM s JOIN t USING (session, k)), i AS (
  SELECT session, 'selected_twice' AS issue FROM s GROUP BY session, k HAVING count(*) > 1 UNION ALL SELECT session, 'unknown_take' FROM s ANTI JOIN t USING (session, k)
  UNION ALL SELECT session, 'several_takes' FROM k GROUP BY session, k % 5, k % 4 HAVING count(DISTINCT k) > 1
  UNION ALL SELECT session, 'no_take' FROM (SELECT DISTINCT session, k % 5 AS a, k % 4 AS b FROM t) c ANTI JOIN (SELECT session, k % 5 AS a, k % 4 AS b FROM k) x USING (session, a, b)
) SELECT session, issue, count(*) AS n FROM i GROUP BY ALL""",
    "checkpoint_issues": "SELECT n_regionkey AS session, CASE WHEN bool_or(n_name = 'NATION_7') THEN 'committed_takes' ELSE 'phase' END AS issue FROM nation GROUP BY n_regionkey HAVING bool_or(n_name = 'NATION_7') OR n_regionkey = 1",
    "snapshot_issues": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 50 WHEN 3 THEN 'gone' WHEN 5 THEN 'new' ELSE 'changed' END AS issue FROM documents WHERE text IS NOT NULL AND doc_id % 50 IN (3, 4, 5)",
    "bench_lags": """SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_suppkey * 100 END AS INTEGER) AS rate_hz, s_acctbal AS lag_samples, CASE WHEN s_suppkey % 4 = 0 THEN 'rate' WHEN s_acctbal < 0 THEN 'lag' END AS issue FROM supplier
UNION ALL SELECT s_suppkey, 48000, 213.0, NULL FROM supplier""",
    "event_levels": """SELECT l_orderkey, CAST(CASE WHEN bool_and(l_discount > 0) THEN count(*) ELSE 0 END AS INTEGER) AS n,
  round(CASE WHEN bool_and(l_discount > 0) THEN sum(10 * log10(CASE WHEN l_discount > 0 THEN l_discount * 10 / l_quantity ELSE 1 END)) ELSE 0 END, 4) AS total_db FROM lineitem GROUP BY l_orderkey""",
    "gathered_sources": """WITH g AS (SELECT l_orderkey % 500 AS source_id, count(DISTINCT l_suppkey % 10) AS n, max(l_discount * 1000) AS lo, min(l_quantity * 100 + 60) AS hi, list_sort(list(l_tax), 'DESC') AS b FROM lineitem GROUP BY ALL)
SELECT source_id, round(lo, 6) AS low_hz, round(hi, 6) AS high_hz, round(list_sum(b[1:2]), 6) AS bound_us FROM g WHERE n = 10 AND lo < hi""",
    "restored_quality": "SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 AND c_custkey % 5 <> 0 AND c_custkey % 28 <> 1 THEN c_acctbal + 1 END, 2) AS quality FROM customer",
}

QUERIES = [journal_issues, selection_issues, checkpoint_issues, snapshot_issues, bench_lags, event_levels, gathered_sources, restored_quality]
