"""Merkle manifest of a dataset: a tree of leaves for each source, and one of their roots.

A leaf is the SHA-256 of a document's fields, each with its length in bytes. In a source, leaves are ordered by id; every
three neighbours become their hash, again and again. Superblock reduction: a node's block is its place over 3^7, so a task
that has a block raises seven levels at once; the blocks' roots are nodes in their turn, until each source has one, and the
sources' roots are raised in the same way. Down again, each block gets the path of its own root and puts it behind the paths
in the block, so a proof is the lower and the upper parts joined. A task holds a block of 2,187 digests, whatever a source's
size; places come from a sort by ranges, so a source that has most rows is dealt out like any other. Sources of one leaf
need no block.

Defined cases: fields that are null count as ``-``; a null source is a source, the first; null ids come first in a source;
rows of equal ids are ordered by their leaves, so repeated rows are leaves of their own; an empty table gives no row; a
text's length doesn't matter (it is hashed where it is read); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import crc32_sql, id_bucket, materialise
from kinespark.llm.ordered import scanned
from kinespark.session import ship_package

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, index long, n long, node string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**other: Column) -> Column:
    """The hash of the fields; other ones may stand in for columns of the same name."""
    return F.sha2(F.concat(*[_field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(n: int, fanout: int, most: int) -> int:
    """Levels that a block of a tree of n nodes raises."""
    out = 0
    while out < most and n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def raised(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, from those given to the block's root."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def paths(levels: list[list[str]], fanout: int = FANOUT) -> list[list[str]]:
    """For each node of the first level: a text for each level, its place in the run and its siblings."""
    out: list[list[str]] = [[] for _ in levels[0]]
    for j, row in enumerate(levels[:-1]):
        for i, path in enumerate(out):
            at = i // fanout**j
            start = at - at % fanout
            path.append(f"{at - start}{''.join(row[start:at] + row[at + 1 : start + fanout])}")
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and a path lead to."""
    for step in path:
        cut = 1 + 64 * int(step[0])
        node = digest([step[1:cut], node, step[cut:]])
    return node


def _climb(nodes: DataFrame, fanout: int, levels: int, label: str) -> list[DataFrame]:
    """Stages of nodes (tree, index, n, node); the last has one for each tree."""
    size, stages = fanout**levels, [nodes]

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("index"), int(rows["n"].iloc[0])
        root = raised(rows["node"].tolist(), _levels(n, fanout, levels), fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "index": [key[1]], "n": [-(-n // size)], "node": root})

    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        last = stages[-1]
        up = last.filter("n > 1").groupBy("tree", F.expr(f"index div {size}").alias("block")).applyInPandas(block, _NODE)
        stages.append(materialise(up.unionByName(last.filter("n = 1").select("tree", "index", "n", "node")), label))
    return stages


def _descend(nodes: DataFrame, up: DataFrame, fanout: int, levels: int, carry: list[str]) -> DataFrame:
    """nodes with their paths; up: tree, index (of the block), path and what else holds for all below it. carry: columns of
    nodes that come along."""
    size, over = fanout**levels, [c for c in up.columns if c not in ("tree", "index", "path")]
    kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *up.schema]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("tree", "index", *carry, *over, "path"))

    def block(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # trees of one node have no block
            return pd.DataFrame(columns=["tree", "index", *carry, *over, "path"])
        rows, above = rows.sort_values("index"), above.iloc[0]
        own = paths(raised(rows["node"].tolist(), _levels(int(rows["n"].iloc[0]), fanout, levels), fanout), fanout)
        upper = list(above["path"])
        return rows[["tree", "index", *carry]].assign(**{c: above[c] for c in over}, path=[p + upper for p in own])

    many = nodes.filter("n > 1").withColumn("block", F.expr(f"index div {size}"))
    inner = many.groupBy("tree", "block").cogroup(up.withColumnRenamed("index", "block").groupBy("tree", "block")).applyInPandas(block, schema)
    alone = nodes.filter("n = 1").join(up.filter("index = 0").drop("index"), "tree").select("tree", "index", *carry, *over, "path")
    return inner.unionByName(alone)


def proofs(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves: source, doc_id, leaf and any other columns. Adds subroot, root and path (an array: for each level, the place
    in its run and the siblings)."""
    if not 2 <= fanout <= 10 or levels < 1:
        raise ValueError("a fanout from 2 to 10 and a level are needed")
    spark = leaves.sparkSession
    ship_package(spark)
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    carry = [c for c in leaves.columns if c != "leaf"]
    own = leaves.select(F.struct(*leaves.columns).alias("row"), key.alias("key"), "doc_id", "leaf")
    written = materialise(own.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = scanned(written, ["key", "doc_id", "leaf", "tie"], "places", key="key").drop("tie")
    counts = materialise(placed.groupBy("key").agg(F.count("*").alias("n")), "sources")
    sources = scanned(counts, ["key"], "source-order").withColumnRenamed("rank", "tree")
    total = sources.count()
    nodes = placed.join(sources, "key").select("tree", F.col("rank").alias("index"), "n", F.col("leaf").alias("node"), "row")
    stages = _climb(materialise(nodes, "nodes"), fanout, levels, "blocks")
    subroots = stages[-1].select("tree", F.col("node").alias("subroot"))
    top = materialise(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(total).cast("long").alias("n"), F.col("subroot").alias("node")), "subroots")
    tops = _climb(top, fanout, levels, "top-blocks")
    up = tops[-1].select("tree", "index", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    for stage in reversed(tops[:-1]):
        up = materialise(_descend(stage, up, fanout, levels, []), "top-paths")
    up = up.select(F.col("index").alias("tree"), "path", "root").join(subroots, "tree").withColumn("index", F.lit(0).cast("long"))
    up = materialise(up, "paths")
    for stage in reversed(stages[1:-1]):
        up = materialise(_descend(stage, up, fanout, levels, []), "paths")
    out = _descend(stages[0], up, fanout, levels, ["row"]) if len(stages) > 1 else stages[0].join(up.drop("index"), "tree")
    return out.select("row.*", "subroot", "root", "path")


def proof_of(path: Column) -> Column:
    """The hash of a path's siblings, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.substring(p, 2, 1 << 20))), 256)


def folded_root(node: Column, path: Column) -> Column:
    """What a leaf and a path lead to; the proof holds where this is the root."""

    @F.pandas_udf("string")
    def fold(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for nodes, steps in parts:
            yield pd.Series([folded(a, b) for a, b in zip(nodes, steps, strict=True)], dtype=object)

    return fold(node, path)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of each document."""
    return proofs(docs.select("doc_id", "source", leaf().alias("leaf")), fanout, levels)


def verified_edits(docs: DataFrame) -> DataFrame:
    """The manifest against documents whose line feeds are gone where 2 divides the id's crc32: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified. Documents without an id aren't edited."""
    edited = F.coalesce(id_bucket(2) == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    now = F.when(edited, leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    told = proofs(docs.select("doc_id", "source", leaf().alias("leaf"), now.alias("now")))
    told = told.withColumn("folded_root", folded_root(F.coalesce("now", "leaf"), F.col("path")))
    return told.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    each = {c: f"CAST({c} AS VARCHAR)" for c in FIELDS} | {"text": text}
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || {v} END" for c, v in each.items()) + ")"


def _raised_sql(name: str, nodes: str) -> str:
    return f"""{name} AS (
    SELECT tree, 0 AS lvl, idx, node FROM {nodes}
    UNION ALL
    SELECT tree, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}) q WHERE c > 1 GROUP BY tree, lvl, idx // 3)"""


#: The trees and proofs by recursion.
SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS r
    FROM (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("CASE WHEN doc_id IS NOT NULL AND " + crc32_sql("CAST(doc_id AS VARCHAR)") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS edited FROM documents) d),
first AS (SELECT tree, idx, leaf AS node FROM leaves),
{_raised_sql("inner_nodes", "first")},
subroots AS (SELECT 0 AS tree, tree AS idx, node FROM inner_nodes QUALIFY lvl = max(lvl) OVER (PARTITION BY tree)),
{_raised_sql("top_nodes", "subroots")},
steps AS (
    SELECT l.r, n.lvl, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx < l.idx // (3 ** n.lvl)::BIGINT), '') AS before, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx > l.idx // (3 ** n.lvl)::BIGINT), '') AS after
    FROM leaves l JOIN inner_nodes n ON n.tree = l.tree AND n.idx // 3 = l.idx // (3 ** (n.lvl + 1))::BIGINT JOIN (SELECT tree, max(lvl) AS most FROM inner_nodes GROUP BY tree) m ON m.tree = l.tree AND n.lvl < m.most GROUP BY l.r, n.lvl
    UNION ALL
    SELECT l.r, m.most + n.lvl, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx < l.tree // (3 ** n.lvl)::BIGINT), ''), coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx > l.tree // (3 ** n.lvl)::BIGINT), '')
    FROM leaves l JOIN (SELECT tree, max(lvl) AS most FROM inner_nodes GROUP BY tree) m ON m.tree = l.tree JOIN top_nodes n ON n.idx // 3 = l.tree // (3 ** (n.lvl + 1))::BIGINT AND n.lvl < (SELECT max(lvl) FROM top_nodes) GROUP BY l.r, m.most, n.lvl),
folds AS (
    SELECT r, 0 AS lvl, edited AS node FROM leaves
    UNION ALL
    SELECT f.r, f.lvl + 1, sha256(s.before || f.node || s.after) FROM folds f JOIN steps s ON s.r = f.r AND s.lvl = f.lvl),
ends AS (SELECT r, node FROM folds QUALIFY lvl = max(lvl) OVER (PARTITION BY r))
SELECT l.doc_id, l.leaf, s.node AS subroot, t.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM leaves l JOIN subroots s ON s.idx = l.tree JOIN ends e ON e.r = l.r LEFT JOIN (SELECT r, string_agg(before || after, '' ORDER BY lvl) AS proof FROM steps GROUP BY r) p ON p.r = l.r,
    (SELECT node FROM top_nodes ORDER BY lvl DESC LIMIT 1) t
"""
