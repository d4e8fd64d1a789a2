"""What the operators of this subpackage share: the folder for cut lineage, texts and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinespark.session import ship_package

_LOCAL: dict[str, str] = {}
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this process only where that is unset, as in local tests."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="kinespark-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kinespark/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run inside go when each of them ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df in the shared folder and reads it back: later steps start from files that outlive any executor, so the
    shuffle files behind them are freed."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows of docs as one column ``row`` beside own ones, so no name of theirs can meet one of ours; ``row.*`` gives
    them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; an id that is null has none."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def ready(spark: SparkSession) -> None:
    """Workers get the package, and texts in batches that are small however long the texts are."""
    ship_package(spark)
    spark.conf.set(_BATCH_BYTES, _BYTES)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """fn makes columns from each record batch; a batch's rows never leave their partition. done is called after the last."""
    ready(df.sparkSession)
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            if made is not None:
                yield pa.RecordBatch.from_pydict(made, schema=out)
        if done:
            done()

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a SQL text of ASCII characters, bit by bit, for DuckDB."""
    step = "list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, ch: {step}), 4294967295)"
