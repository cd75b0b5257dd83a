"""The bound tables: what the review tables are read from in the test data, in SQL that Spark and
DuckDB both take (VARCHAR is STRING in Spark)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS = {
    "b_labels": """SELECT c_custkey AS case_id, CAST(floor(c_custkey/2) AS BIGINT) AS pair_id,
      CASE WHEN c_custkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS label,
      CASE WHEN c_custkey % 2 = 0 THEN concat('class', CAST(c_nationkey % 10 AS VARCHAR)) END AS class,
      c_mktsegment AS subsystem,
      CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_acctbal > 5000 END AS fix_before_cutoff,
      CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor(c_custkey/2) AS BIGINT) % 5 = 0 END AS fallback_pair,
      CASE c_custkey % 12 WHEN 0 THEN split('subsystem', ',') WHEN 3 THEN split('subsystem,size', ',') WHEN 6 THEN split('size', ',') WHEN 9 THEN CASE WHEN c_custkey % 24 = 9 THEN split('Subsystem', ',') ELSE regexp_extract_all('a', 'b', 0) END END AS match_key_used,
      CASE WHEN c_nationkey % 4 <> 0 THEN concat('described ', CAST(c_nationkey % 3 AS VARCHAR)) END AS admission_description,
      CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN concat('window ', CAST(c_custkey % 3 AS VARCHAR)) END AS source,
      CASE WHEN c_custkey % 2 = 0 THEN 'window 9' END AS source_window FROM customer""",
    "b_all_runs": """SELECT o_orderkey AS run_id, o_custkey AS case_id,
      CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'G' END AS arm,
      CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders""",
    "b_runs": "SELECT min(run_id) AS run_id, case_id, arm FROM b_all_runs WHERE status = 'completed' GROUP BY case_id, arm",
    "b_findings": """SELECT l_orderkey AS run_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,
      CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 30 THEN 'medium' WHEN l_quantity < 45 THEN 'high' ELSE 'critical' END AS severity,
      round(l_discount * 10, 1) AS confidence,
      concat('src/p', CAST(l_partkey % 50 AS VARCHAR), '.c') AS file,
      concat('tests/d', CAST(l_partkey % 40 AS VARCHAR)) AS rec_path,
      CASE l_partkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'NARROWED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'INCONCLUSIVE' END AS b_disp,
      CASE l_suppkey % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'NARROWED' WHEN 2 THEN 'REJECTED' END AS c_disp,
      CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'MECHANISM' WHEN 1 THEN 'LOCALITY_ONLY' WHEN 2 THEN 'NONE' ELSE 'TOO_VAGUE' END AS agreement,
      concat('x', CAST(l_suppkey % 3 AS VARCHAR)) AS fix_id, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem""",
    # stage 2 ranks anew, states its own mechanism and paths, may assess twice, or what is no finding
    "b_assessments": """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY suppkey % 7, pos DESC) - 1 AS pos, pos AS finding_id, b_disp AS disposition,
      concat('narrower: ', file) AS mechanism, CASE WHEN suppkey % 4 <> 0 THEN concat('tests/d', CAST((partkey + 3) % 40 AS VARCHAR)) END AS rec_path FROM b_findings WHERE b_disp IS NOT NULL
      UNION ALL SELECT run_id, 50, 0, 'NARROWED', 'again', 'tests/again' FROM b_all_runs WHERE run_id % 19 = 0 AND run_id IN (SELECT run_id FROM b_findings)
      UNION ALL SELECT run_id, 60, 999, CASE WHEN run_id % 2 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END, 'phantom', NULL FROM b_all_runs WHERE run_id % 46 = 0 OR run_id % 58 = 1""",
    "b_history": """SELECT c_custkey AS case_id, CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_acctbal < 3000 END AS risky,
      CASE WHEN c_nationkey % 7 = 0 THEN 'base not resolved' END AS reason FROM customer WHERE c_custkey % 11 <> 0""",
    "b_fixing_paths": "SELECT c_custkey AS case_id, concat('tests/d', CAST(c_custkey % 40 AS VARCHAR), '/t', CAST(c_custkey % 3 AS VARCHAR), '.py') AS path FROM customer WHERE c_custkey % 9 <> 0",
    "b_fixes": "SELECT case_id, concat('x', CAST(k AS VARCHAR)) AS fix_id FROM b_labels JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) f ON 1 = 1 WHERE label = 'positive'",
    "b_signals": """SELECT p_partkey AS case_id, concat('src/p', CAST(p_partkey % 50 AS VARCHAR), '.c') AS path, p_size % 3 + 1 AS tier, p_type AS signal_type,
      concat('sym', CAST(p_partkey % 7 AS VARCHAR)) AS symbol, p_size AS overlap FROM part JOIN b_labels ON p_partkey = case_id""",
    "b_attempts": """SELECT user_id AS run_id, event_id % 3 + 1 AS stage, row_number() OVER (PARTITION BY user_id, event_id % 3 + 1 ORDER BY ts, event_id) AS attempt,
      event_type = 'error' AS failed, value / 100 AS cost_usd, event_id % 5000 AS tokens, event_id % 7 AS tool_calls, ts FROM events""",
}


def needed(names: list[str], sql: str = "") -> list[str]:
    """The bound tables that these and `sql` read, each after those it is made from."""
    out: list[str] = []

    def add(text: str) -> None:
        for n in BINDINGS:
            if n not in out and re.search(rf"\b{n}\b", text):
                add(BINDINGS[n])
                out.append(n)

    add(" ".join(names) + " " + sql)
    return out


def with_bindings(sql: str) -> str:
    """DuckDB SQL with the bound tables it names put before it."""
    names = needed([], sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names)
    return f"WITH {head},\n{sql[len('WITH '):]}" if sql.startswith("WITH ") else f"WITH {head}\n{sql}"


def bound(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A table of the test data or a bound table made from them, or from those `given` in place of bound ones."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names, made = [n for n in needed([name]) if n not in given], dict(BINDINGS)
    for n in given:
        made = {k: re.sub(rf"\b{n}\b", f"{{{n}}}", v) for k, v in made.items()}
    head = ", ".join(f"{n} AS ({made[n]})" for n in names)
    sql = f"WITH {head} SELECT * FROM {name}".replace("VARCHAR", "STRING")
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql, **given)
