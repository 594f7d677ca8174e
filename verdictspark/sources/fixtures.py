"""Portable views over the benchmark tables: the same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View text, and the tables or views that it reads.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ladder_verdicts": (
        """
SELECT concat('m', event_id % 3)                         AS auditor,
       CASE event_type WHEN 'view' THEN 'R0' WHEN 'click' THEN 'R0p' WHEN 'purchase' THEN 'R1'
                       WHEN 'signup' THEN 'R2' ELSE 'R3' END AS condition,
       concat('F', 1 + (event_id % 5))                   AS family,
       user_id                                           AS item_id,
       CASE WHEN user_id % 2 = 0 THEN 'clean' ELSE 'incorrect' END AS arm,
       CAST(row_number() OVER (PARTITION BY event_id % 3, event_type, user_id
                               ORDER BY ts, event_id) - 1 AS BIGINT) AS sample,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 <> 0 AS parsed,
       CASE WHEN value > 50 THEN 1 ELSE 0 END            AS flag,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS confidence,
       CASE WHEN value > 50 THEN 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 END AS step,
       user_id % 5                                       AS gold_label,
       user_id % 10                                      AS episode_id
FROM events
""",
        ('events',),
    ),
    "r4_verdicts": (
        """
SELECT concat('m', event_id % 2) AS auditor,
       CASE concat(event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2)
         WHEN 'view0' THEN 'R0' WHEN 'view1' THEN 'AS' WHEN 'click0' THEN 'AO' WHEN 'click1' THEN 'US'
         WHEN 'purchase0' THEN 'UO' WHEN 'purchase1' THEN 'AF' WHEN 'signup0' THEN 'AV'
         WHEN 'signup1' THEN 'AN' WHEN 'error0' THEN 'AX' ELSE 'AXN' END AS condition,
       user_id AS item_id,
       CASE WHEN value > 50 THEN 1 ELSE 0 END AS flag,
       user_id % 10 AS episode_id, user_id % 7 AS ax_episode_id
FROM events
""",
        ('events',),
    ),
    "trace_steps": (
        """
SELECT l_orderkey AS item_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS step_no,
       CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b,
       CAST(l_quantity AS BIGINT) + l_linenumber
         + CASE WHEN CAST(l_quantity AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS r,
       CAST(l_quantity AS BIGINT) % 5 <> 0 AS has_claim
FROM lineitem
""",
        ('lineitem',),
    ),
    "trace_text": (
        """
SELECT item_id, step_no, a, b, r, has_claim,
       CASE WHEN has_claim THEN concat('We add items: ', a, ' + ', b, ' = ', r, '.')
            ELSE 'We reason abstractly here.' END AS step_text
FROM trace_steps
""",
        ('trace_steps',),
    ),
    "traces": (
        """
SELECT s.item_id, lower(substr(o.o_orderpriority, 3)) AS split, count(*) AS n_steps,
       coalesce(min(CASE WHEN s.has_claim AND s.a + s.b <> s.r THEN s.step_no - 1 END), -1) AS label
FROM trace_steps s JOIN orders o ON o.o_orderkey = s.item_id
GROUP BY s.item_id, lower(substr(o.o_orderpriority, 3))
""",
        ('trace_steps', 'orders'),
    ),
    "alloc_pool": (
        """
SELECT d.doc_id AS item_id, d.lang AS split, d.n_chars >= 400 AS eligible,
       CASE WHEN l.quality = 1 THEN -1 WHEN l.quality = 0 THEN 0 END AS label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
        ('documents', 'labels'),
    ),
    "episodes": (
        """
SELECT conv_id AS pos, concat('ep-', conv_id) AS item_id,
       max(CASE WHEN role = 'user' AND turn <= 1 THEN text END)      AS request,
       max(CASE WHEN role = 'assistant' AND turn <= 2 THEN text END) AS audit,
       max(CASE WHEN role = 'assistant' AND turn >= 3 THEN text END) AS repair
FROM conversations GROUP BY conv_id
""",
        ('conversations',),
    ),
}


def _needed(name: str) -> list[str]:
    found: list[str] = []
    for d in VIEWS[name][1]:
        if d in VIEWS:
            found += [x for x in _needed(d) if x not in found]
    return [*found, name]


def oracle_views(*names: str) -> str:
    """WITH-clause entries for the named views and those that they read."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needed(n) if x not in order]
    return ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    sql, reads = VIEWS[name]
    frames = {d: view(spark, sf_dir, d) if d in VIEWS else table(spark, sf_dir, d) for d in reads}
    for d in reads:
        sql = _named(sql, d)
    return spark.sql(sql, **frames)


def _named(sql: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return sql
