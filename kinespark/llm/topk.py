"""Exact top-k search by inner product with an impact-ordered score-at-a-time index.

A vector's components are whole numbers. The impact of a component is its size, quantised down to the sizes that
``SHARES`` of the shard's components reach; a posting segment holds the components of one impact. Segments are scored in descending impact, for
all queries of a block together: what a vector has scored so far is known exactly, and what its smaller components can still
add is bounded by Cauchy and Schwarz, and by the largest of them times the query's sum of sizes, whichever is less. A
vector whose upper bound is below the k-th best lower bound is out, on proof. A query stops where ``FEW`` in a hundred or
fewer are left, or none smaller comes; those left are rescored exactly, with ties at the edge kept. ``skipped`` tells what
share of the postings a search leaves unread.

Rows are dealt to shards of ``ROWS``, queries to blocks of ``QUERIES``; a shard's rows go once to each block, so what moves
is rows x blocks + queries x shards, and only k rows a query and shard go on. Queries and rows whose vector is null, or
holds a null or a component that isn't finite, take no part; vectors meet those of their own length alone. Ids that repeat
stand for themselves, but a query is never its own candidate: rows with its id are left out; queries that repeat an id ask
together. A null id takes no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import ready


ROWS, QUERIES, FEW, STEP = 32_768, 4096, 3, 128
SHARES = (0.5, 0.65, 0.7, 0.75, 0.8, 0.9)


def scaled(name: str = "embedding", by: int = 256) -> Column:
    """floor(by * x) of each component as a whole number."""
    return F.transform(F.col(name).cast("array<double>"), lambda x: F.floor(x * by).cast("long"))


def usable(name: str = "embedding") -> Column:
    sound = F.forall(F.col(name).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(name).isNotNull() & F.coalesce(sound, F.lit(False))


class ImpactIndex:
    """One shard's posting segments, the largest impact first."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float64)
        size = np.abs(self.rows)
        edges = np.unique(np.r_[0.0, np.quantile(size, [1 - s for s in SHARES]) if size.size else []])[::-1]
        self.segments, left, above = [], (self.rows**2).sum(axis=1), np.inf
        for edge in edges:
            own = (size >= edge) & (size < above)
            part = np.where(own, self.rows, 0.0)
            left = np.maximum(left - (part**2).sum(axis=1), 0.0)
            # what is below the edge: its norm, a hair more than computed, and its largest size
            self.segments.append((part, np.sqrt(left * (1 + 1e-9)), float(size[size < edge].max(initial=0)), int(own.sum())))
            above = edge

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query the places and scores of all rows that can be among its k best, and how many postings were read;
        own marks rows left out."""
        q = queries.astype(np.float64)
        norm, total = np.sqrt((q**2).sum(axis=1) * (1 + 1e-9)), np.abs(q).sum(axis=1)
        got, read = np.zeros((len(q), len(self.rows))), 0
        k = min(k, len(self.rows))
        for part, left, most, n in self.segments:
            got += q @ part.T
            read += n * len(q)
            more = np.minimum(norm[:, None] * left[None, :], (total * most)[:, None])
            low = np.where(own, -np.inf, got - more)
            edge = -np.partition(-low, k - 1, axis=1)[:, k - 1]
            open_ = ~own & (got + more >= edge[:, None])
            if open_.sum() * 100 <= FEW * got.size or open_.sum() <= 2 * k * len(q):
                break
        return [(at := np.flatnonzero(o), (self.rows[at] @ one).astype(np.int64)) for o, one in zip(open_, q, strict=True)], read


def skipped(queries: np.ndarray, rows: np.ndarray, k: int) -> float:
    """The share of postings that a search over one shard leaves unread."""
    read = ImpactIndex(rows).search(queries, k, np.zeros((len(queries), len(rows)), bool))[1]
    return 1 - read / (len(queries) * rows.size)


def _tile(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        ids, asked = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        index = ImpactIndex(np.stack(rows["x"].to_numpy()))
        wanted = np.stack(queries["x"].to_numpy())
        for at in range(0, len(asked), STEP):
            own = asked[at : at + STEP, None] == ids[None, :]
            for query, (places, scores) in zip(asked[at : at + STEP], index.search(wanted[at : at + STEP], k, own)[0], strict=True):
                best = np.lexsort((ids[places], -scores))[:k]
                out["query_id"].append(np.full(len(best), query))
                out["vec_id"].append(ids[places][best])
                out["score"].append(scores[best])
    return pd.DataFrame({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()})


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, x) of whole numbers in; query_id, rank, vec_id, score out: the k best rows of each query, ties to the smaller id."""
    ready(rows.sparkSession)
    queries, rows = (df.select("vec_id", "x", F.size("x").alias("length")).filter("length > 0") for df in (queries, rows))
    # at least as many shards as tasks can run, whole ones of ROWS beyond
    n, least = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = F.lit(max(1, min(least, -(-n // 1024)), -(-n // ROWS)))
    blocks = F.lit(max(1, -(-queries.count() // QUERIES)))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    asked = queries.select("vec_id", "x", "length", part(blocks, 1).alias("block"), all_of(shards).alias("shard"))
    there = rows.select("vec_id", "x", "length", part(shards, 2).alias("shard"), all_of(blocks).alias("block"))
    tile = ["length", "shard", "block"]
    some = asked.groupBy(*tile).cogroup(there.groupBy(*tile)).applyInPandas(lambda a, b: _tile(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vectors(table: DataFrame) -> DataFrame:
    return table.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled().alias("x"))


#: The same in SQL over the table embeddings.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""
