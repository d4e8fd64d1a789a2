"""Result documents as a table: <root>/<metric>/<prompt>/result.json, read and written by Spark's data source interface.

    spark.dataSource.register(ResultTree)
    spark.read.format("result_tree").load(root)                    # metric, prompt_id, document
    frame.write.format("result_tree").mode("append").save(root)

A metric's folder is a partition. Filters on metric and prompt_id by equality or a list are pushed down: other folders and
files aren't opened (session setting spark.sql.python.filterPushdown.enabled; without it Spark filters the rows).

Writing has two phases. A task writes its documents below <root>/_staging/<job>/ under names of its own and reports them. When
all tasks have ended, the driver writes a manifest of what goes where and renames each file into its place, so a reader sees a
document whole or not at all. If a task fails for good, the staged files go and the tree is as it was. If the driver dies
while it renames, ``recover`` finishes what manifests are left and removes staged files that no manifest names. mode("overwrite")
also removes the documents that weren't written, after the renames. Roots are paths or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from kinespark.session import ship_package

SCHEMA, NAME, STAGING = "metric string, prompt_id string, document string", "result.json", "_staging"


def _opened(root: str):
    """File system and path of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9+.-]+://|file:", root) else (fs.LocalFileSystem(), root)


def _names(system, path: str, kind: str) -> list[str]:
    from pyarrow import fs

    own = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    want = fs.FileType.Directory if kind == "folder" else fs.FileType.File
    return sorted(f.base_name for f in own if f.type == want and not (kind == "folder" and f.base_name.startswith(("_", "."))))


class Folder(InputPartition):
    def __init__(self, metric: str, prompts: list[str] | None):
        super().__init__(metric)
        self.metric, self.prompts = metric, prompts


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.wanted: dict[str, set[str] | None] = {"metric": None, "prompt_id": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("metric",), ("prompt_id",)):
                continue  # folders have names
            values = {f.value} if isinstance(f, EqualTo) else {*f.value} if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in self.wanted and all(isinstance(v, str) for v in values):
                known = self.wanted[column]
                self.wanted[column] = values if known is None else known & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.root)
        prompts = self.wanted["prompt_id"]
        folders = [m for m in _names(system, path, "folder") if self.wanted["metric"] is None or m in self.wanted["metric"]]
        return [Folder(m, None if prompts is None else sorted(prompts)) for m in folders] or [Folder("", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = _opened(self.root)
        prompts = partition.prompts if partition.prompts is not None else _names(system, f"{path}/{partition.metric}", "folder")
        for prompt in prompts:
            file = f"{path}/{partition.metric}/{prompt}/{NAME}"
            if system.get_file_info(file).type == fs.FileType.NotFound:
                continue
            with system.open_input_stream(file) as f:
                yield partition.metric, prompt, f.read().decode("utf-8", "replace")


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _moved(system, path: str, files: list[tuple[str, str]]) -> None:
    from pyarrow import fs

    for staged, final in files:
        if system.get_file_info(f"{path}/{staged}").type == fs.FileType.NotFound:
            continue  # an earlier try has moved it
        system.create_dir(f"{path}/{final.rpartition('/')[0]}", recursive=True)
        system.move(f"{path}/{staged}", f"{path}/{final}")


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, path = _opened(self.root)
        attempt, files = uuid.uuid4().hex, []
        system.create_dir(f"{path}/{STAGING}/{self.job}", recursive=True)
        for n, row in enumerate(iterator):
            for part in (row["metric"], row["prompt_id"]):
                if not part or "/" in part or part.startswith((".", "_")):
                    raise ValueError(f"no name of a folder: {part!r}")
            staged = f"{STAGING}/{self.job}/{attempt}-{n}"
            with system.open_output_stream(f"{path}/{staged}") as f:
                f.write((row["document"] or "null").encode())
            files.append((staged, f"{row['metric']}/{row['prompt_id']}/{NAME}"))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = _opened(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        finals = {f for _, f in files}
        if len(finals) < len(files):
            self.abort(messages)
            raise ValueError("two documents have one place")
        gone = [old for old in _documents(system, path) if old not in finals] if self.overwrite else []
        _said(system, path, self.job, {"files": files, "gone": gone})
        _finished(system, path, self.job, {"files": files, "gone": gone})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, path = _opened(self.root)
        if system.get_file_info(f"{path}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{STAGING}/{self.job}")


def _documents(system, path: str) -> list[str]:
    """The places of all documents below path."""
    from pyarrow import fs

    found = [f"{m}/{p}/{NAME}" for m in _names(system, path, "folder") for p in _names(system, f"{path}/{m}", "folder")]
    return [f for f in found if system.get_file_info(f"{path}/{f}").type == fs.FileType.File]


def _said(system, path: str, job: str, manifest: dict) -> None:
    """The manifest is whole or not there, too."""
    system.create_dir(f"{path}/{STAGING}", recursive=True)
    with system.open_output_stream(f"{path}/{STAGING}/{job}.partial") as f:
        f.write(json.dumps(manifest).encode())
    system.move(f"{path}/{STAGING}/{job}.partial", f"{path}/{STAGING}/{job}.manifest")


def _finished(system, path: str, job: str, manifest: dict) -> None:
    from pyarrow import fs

    _moved(system, path, [tuple(f) for f in manifest["files"]])
    for old in manifest["gone"]:
        if system.get_file_info(f"{path}/{old}").type == fs.FileType.File:
            system.delete_file(f"{path}/{old}")
    system.delete_file(f"{path}/{STAGING}/{job}.manifest")
    if system.get_file_info(f"{path}/{STAGING}/{job}").type != fs.FileType.NotFound:
        system.delete_dir(f"{path}/{STAGING}/{job}")


def recover(root: str) -> int:
    """Finishes commits that were interrupted and removes what others left; to be called while nobody writes. How many
    commits were finished."""
    from pyarrow import fs

    system, path = _opened(root)
    jobs = [f.removesuffix(".manifest") for f in _names(system, f"{path}/{STAGING}", "file") if f.endswith(".manifest")]
    for job in jobs:
        with system.open_input_stream(f"{path}/{STAGING}/{job}.manifest") as f:
            manifest = json.loads(f.read())
        _finished(system, path, job, manifest)
    if system.get_file_info(f"{path}/{STAGING}").type != fs.FileType.NotFound:
        system.delete_dir(f"{path}/{STAGING}")
    return len(jobs)


class ResultTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if missing := {"metric", "prompt_id", "document"} - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return TreeWriter(self.options["path"], overwrite)


def _known(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultTree)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    _known(spark)
    return spark.read.format("result_tree").load(root)


def write_tree(documents: DataFrame, root: str, overwrite: bool = False) -> None:
    """documents: metric, prompt_id, document."""
    _known(documents.sparkSession)
    documents.select("metric", "prompt_id", "document").write.format("result_tree").mode("overwrite" if overwrite else "append").save(root)
