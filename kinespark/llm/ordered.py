"""Ranks and running sums over a whole table in one order, without one task that sees a whole group.

Rows are dealt by ranges of the order and sorted in each; a scan in numpy counts and sums what a task reads, and the result is
written. What the tasks before carry over is then known from one row for each partition: the driver adds those up, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from kinespark.llm.common import materialise, ready


def scanned(df: DataFrame, by: list[str], label: str, key: str | None = None, sums: dict[str, int] | None = None) -> DataFrame:
    """df in the order of ``by``, written, with ``rank`` from 0 on: over all rows, or with a key among the rows of that key
    (``by`` must begin with it; it is never null). sums: names of long columns and a modulus (0: none): ``sum_`` before a name
    has its running sum among those rows, their own row included. Rows that are equal in ``by`` come in any order."""
    sums = sums or {}
    spark = df.sparkSession
    ready(spark)
    own, held = df.columns, [f"run_{c}" for c in sums]
    out = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("part", "place", "rank", *held))])
    schema, at = to_arrow_schema(out), own.index(key) if key else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, carry = TaskContext.get().partitionId(), 0, None, [0] * (1 + len(sums))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            if key:
                keys = batch.column(at)
                starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                starts[0] = last is not None and keys[0].as_py() != last
                last = keys[n - 1].as_py()
            first = np.flatnonzero(starts)
            of = np.cumsum(starts)  # 0: goes on from what was before
            made = []
            for k, (x, modulus) in enumerate([(np.ones(n, np.int64), 0), *((np.asarray(batch.column(own.index(c)), np.int64), m) for c, m in sums.items())]):
                total = np.cumsum(x)
                run = total - np.r_[-carry[k], (total - x)[first]][of]
                run = run % modulus if modulus else run
                carry[k] = int(run[-1])
                made.append(run)
            made[0] = made[0] - 1
            data = [c if c.type == f.type else pc.cast(c, f.type) for c, f in zip(batch.columns, schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*data, pa.array(np.full(n, part)), pa.array(np.arange(place, place + n)), *map(pa.array, made)], schema=schema)
            place += n

    done = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(scan, out), label)
    keyed = F.col(key) if key else F.lit(0)
    ends = done.select("part", "place", keyed.alias("key"), F.struct((F.col("rank") + 1).alias("n"), *held).alias("state"))
    ends = ends.groupBy("part").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"), F.max_by("state", "place").alias("state")).collect()
    carried, before, state = [], None, [0] * (1 + len(sums))
    for r in sorted(ends, key=lambda r: r["part"]):
        goes_on = before is not None and r["first"] == before
        given = state if goes_on else [0] * len(state)
        if goes_on:
            carried.append((r["part"], r["first"], *given))
        state = [x + (y if r["first"] == r["last"] else 0) for x, y in zip(r["state"], given, strict=True)]
        before = r["last"]
    if not carried:
        return done.select(*own, "rank", *[F.col(h).alias(f"sum_{c}") for c, h in zip(sums, held, strict=True)])
    kind = done.schema[key].dataType if key else T.IntegerType()
    names = ["carry_n", *(f"carry_{c}" for c in sums)]
    rows = spark.createDataFrame(carried, T.StructType([T.StructField("part", T.LongType()), T.StructField("carry_key", kind), *(T.StructField(c, T.LongType()) for c in names)]))
    joined = done.join(F.broadcast(rows), "part", "left")  # a row for each partition
    there = F.col("carry_n").isNotNull() & ((F.col(key) == F.col("carry_key")) if key else F.lit(True))
    plus = lambda c, name: F.col(c) + F.when(there, F.col(name)).otherwise(0)
    values = [plus("rank", "carry_n").alias("rank")]
    for (c, modulus), h in zip(sums.items(), held, strict=True):
        value = plus(h, f"carry_{c}")
        values.append((value % modulus if modulus else value).alias(f"sum_{c}"))
    return joined.select(*own, *values)
