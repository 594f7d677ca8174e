"""A Merkle manifest of a table: one hash tree a group, a tree of their roots, a proof for each row.

Rows become leaves; a group's leaves are numbered in order, and every `fanout` consecutive
nodes are hashed into a parent whose number is theirs divided by `fanout`, level by level,
until one node a group is left. The roots of the groups, in order, are the leaves of a last
tree. Each level is a table of its own. On the way down a run's children take their
siblings and their parent's path along, so that the long paths exist once a run below the
leaves and are repeated for the leaves only where they are used.

Null values have a mark of their own, an empty text is not null; very long texts are hashed
row by row in place. Null groups are one group, before all others; null order values come
first, and equal ones go by their leaf, so that repeated rows lie side by side and each has
a proof. A group of one row has that leaf as its root, one group alone has the root of all.
An empty table has no nodes and gives no rows. Other columns may have any names: only the
columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictspark.llm.tables import discard, keep, partitions, read

FANOUT = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digests of the nodes before and behind one node of a run, concatenated, from the leaf upwards.
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value, so that fields can't run into one another."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def proof(path: Column) -> Column:
    """The siblings of a path, left to right and upwards, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `at`, the place from 0 in the group's order, and `n`, the group's size.

    Ranges of (group, order) go to tasks, each numbers its own rows and adds the counts of
    the group's earlier ranges, so no task sees a whole group. The last key parts rows that
    agree in all others; they are interchangeable. rows should be a written table.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    ranges = rows.withColumn("_tie", tie).repartitionByRange(partitions(rows.sparkSession), group, *order, "_tie")
    ranges = keep(ranges.withColumn("_range", F.spark_partition_id()).drop("_tie"), "merkle-ranges")
    counts = ranges.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(group)
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("n"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    placed = ranges.withColumn("_own", own).join(counts, [group, "_range"])
    out = keep(placed.withColumn("at", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before"), "merkle-leaves")
    discard(ranges)
    return out


def _runs(level: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """The runs of a level's unfinished groups: group, parent and the children in order."""
    run = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))
    return level.where("n > 1").groupBy("group", F.expr(f"at div {fanout}").alias("parent")).agg(run.alias("run"), F.first("n").alias("n"))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (group, at, n, digest), from the leaves to the level of the last group's root.

    n is the number of the group's nodes on the level; a group ends on the level where it is 1.
    """
    out = [leaves]
    left = leaves.agg(F.max("n")).first()[0] or 0
    while left > 1:
        digest = F.sha2(F.array_join("run.digest", ""), 256)
        above = _runs(out[-1], fanout).select("group", F.col("parent").alias("at"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest.alias("digest"))
        out.append(keep(above, "merkle-level"))
        left = -(-left // fanout)
    return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """The last node of each group."""
    ends = [t.where("n = 1").select("group", "digest") for t in tables]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def paths(tables: list[DataFrame], start: DataFrame | None, fanout: int, *carried: str) -> DataFrame:
    """The nodes of the lowest table with the path of each; start holds the path above each group's root."""

    def ended(table: DataFrame, *extra: str) -> DataFrame:
        end = table.where("n = 1").select("group", "at", "digest", *extra)
        if start is None:
            return end.withColumn("path", F.array().cast(PATH))
        return end.join(start.select("group", "path"), "group")

    above = ended(tables[-1], *(carried if len(tables) == 1 else ()))
    for k in range(len(tables) - 2, -1, -1):
        extra = carried if k == 0 else ()
        runs = _runs(tables[k], fanout, *extra).join(above.select("group", F.col("at").alias("parent"), "path"), ["group", "parent"])
        child = runs.select("group", "path", "run", F.posexplode("run").alias("i", "child"))
        left, right = F.expr("slice(run.digest, 1, i)"), F.expr("slice(run.digest, i + 2, size(run))")
        step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        below = child.select("group", "child.at", "child.digest", *[f"child.{c}" for c in extra], F.concat(F.array(step), "path").alias("path"))
        above = below.unionByName(ended(tables[k], *extra))
    return above


def manifest(docs: DataFrame, values: list[str], group: str, order: str, fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row: the order column, leaf, subroot, root, its path, and the carried columns.

    values are the columns that a leaf covers, in this order. Only digests, the order column
    and what is carried travel; texts are read once.
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit(":"), docs[group].cast("string")), F.lit(""))
    rows = docs.select(
        key.alias("group"), docs[order].alias("_order"), leaf(*[docs[v] for v in values]).alias("digest"), *[c.alias(f"_{name}") for name, c in carry.items()]
    )
    rows = keep(rows, "merkle-rows")
    lowest = numbered(rows, "group", ["_order", "digest"])
    discard(rows)
    trees = levels(lowest, fanout)
    subroots = keep(roots(trees), "merkle-subroots")
    tops = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("_order"), "digest"), "group", ["_order"])
    top = levels(tops, fanout)
    root = roots(top).first()
    start = paths(top, None, fanout, "_order").select(F.col("_order").alias("group"), F.col("digest").alias("subroot"), "path")
    start = keep(start, "merkle-start")
    carried = ["_order", *[f"_{name}" for name in carry]]
    out = paths(trees, start, fanout, *carried).join(start.select("group", "subroot"), "group")
    return out.select(
        F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", *[F.col(f"_{name}").alias(name) for name in carry]
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their proofs, checked with the texts of a third of them changed."""
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.translate("text", UPPER, UPPER.lower()) if f == "text" else F.col(f) for f in fields]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = manifest(docs, fields, "lang", "doc_id", FANOUT, {"tampered": F.when(tampered, leaf(*changed))})
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 bit by bit, leaves, levels by recursion over all groups at once, paths downwards.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::BIGINT)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))
  ) AS c FROM documents
), tampered AS (
  SELECT *, coalesce(xor(c, 4294967295) % 3 = 0, false) AS bad, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM crc
), enc AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM tampered
), leaves AS (
  SELECT doc_id, bad, coalesce(':' || lang, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf FROM enc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
  SELECT 0 AS lvl, grp, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lvl + 1, grp, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, grp, pos // 8, n
), subroots AS (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 8, n
), all_nodes AS (
  SELECT 'low' AS tree, lvl, grp, pos, n, digest FROM nodes UNION ALL SELECT 'top', lvl, '', pos, n, digest FROM tops
), sides AS (
  SELECT tree, lvl, grp, pos, n, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER behind, '') AS r
  FROM all_nodes WINDOW before AS (PARTITION BY tree, lvl, grp, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    behind AS (PARTITION BY tree, lvl, grp, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), walk AS (
  SELECT p.doc_id, p.leaf, p.grp, CASE WHEN bad THEN low_leaf ELSE leaf END AS fold, '' AS proof, 'low' AS tree, 0 AS lvl, p.grp AS g, p.pos, p.n, p.pos AS leaf_pos FROM placed p
  UNION ALL
  SELECT w.doc_id, w.leaf, w.grp, CASE WHEN w.n > 1 THEN sha256(s.l || w.fold || s.r) ELSE w.fold END, CASE WHEN w.n > 1 THEN w.proof || s.l || s.r ELSE w.proof END,
    CASE WHEN w.n > 1 THEN w.tree ELSE 'top' END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.g ELSE '' END,
    CASE WHEN w.n > 1 THEN w.pos // 8 ELSE b.pos END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE b.n END, w.leaf_pos
  FROM walk w JOIN sides s ON s.tree = w.tree AND s.lvl = w.lvl AND s.grp = w.g AND s.pos = w.pos LEFT JOIN subroots b ON b.grp = w.grp
  WHERE NOT (w.tree = 'top' AND w.n = 1)
)
SELECT w.doc_id, w.leaf, b.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = t.digest AS verified
FROM walk w JOIN subroots b ON b.grp = w.grp CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t WHERE w.tree = 'top' AND w.n = 1
"""
