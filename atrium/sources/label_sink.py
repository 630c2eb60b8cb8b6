"""A training set as a folder of files: written by tasks, there as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = (("labels", "txt", "content"), ("images", "png", "image"))

#: The folder with the lists of what each task wrote.
NAMES = "names"

#: Files whose content stands in a task's memory at once.
AT_ONCE = 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; without a scheme it is a local one, which all executors must share."""
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class FileWriter(DataSourceWriter):
    """A file of each row (path, content), at its path below the folder.

    Tasks write below a folder of this job's own; a task that runs twice writes the same files again. The commit moves
    that folder to its place, one rename whatever the number of files, and an abort removes it. Each task lists what it
    wrote in a file of its own under names/, so that readers needn't list folders of millions of files in one process.
    """

    def __init__(self, path: str):
        self.path, self.staged = path.rstrip("/"), f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"

    def store(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, and both folders in it."""
        store, path = opened(self.path)
        return store, path, f"{path}{self.staged[len(self.path) :]}"

    def begin(self) -> LabelWriter:
        """Makes the job's folder. Tasks go on only while it is there, so that none of a failed job makes it again."""
        store, _, staged = self.store()
        store.create_dir(staged, recursive=True)
        return self

    def files(self, r: Row) -> Iterator[tuple[str, str | bytes, list[str] | None]]:
        """(path, data, what the list says of it, if anything) of a row's files."""
        yield r["path"], r["content"], [r["path"]]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, _, staged = self.store()
        known = set()
        context = TaskContext.get()
        if store.get_file_info(staged).type == fs.FileType.NotFound:
            raise RuntimeError("the job was aborted")
        store.create_dir(f"{staged}/{NAMES}", recursive=True)
        with store.open_output_stream(f"{staged}/{NAMES}/{context.partitionId() if context else 0:06d}.json") as listed:
            for r in rows:
                if store.get_file_info(staged).type == fs.FileType.NotFound:
                    raise RuntimeError("the job was aborted")
                for path, data, name in self.files(r):
                    if data is None:
                        continue
                    place = f"{staged}/{path}".rsplit("/", 1)[0]
                    if place not in known:
                        store.create_dir(place, recursive=True)
                        known.add(place)
                    with store.open_output_stream(f"{staged}/{path}") as out:
                        out.write(data.encode() if isinstance(data, str) else bytes(data))
                    if name:
                        listed.write(json.dumps(name).encode() + b"\n")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path, staged = self.store()
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)
        store.move(staged, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, staged = self.store()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class LabelWriter(FileWriter):
    """labels/<split>/<name>.txt and images/<split>/<name>.png of rows (name, split, content, image)."""

    def files(self, r: Row) -> Iterator[tuple[str, str | bytes, list[str] | None]]:
        for folder, suffix, column in KINDS:
            yield f"{folder}/{r['split']}/{r['name']}.{suffix}", r[column], [r["split"], r["name"]] if folder == "labels" else None


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"]).begin()


class LabelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_files"

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options["path"]).begin()


def write_files(content: DataFrame, out: str) -> None:
    """A file of each row of content (path, content) below out, in place of what stood there; all at once or none."""
    content.sparkSession.dataSource.register(FileSource)
    content.select("path", "content").write.format("single_files").option("path", out).mode("append").save()


def listed(spark: SparkSession, out: str) -> DataFrame | None:
    """What the tasks that wrote the files under out listed, once each, as arrays of text; none if there is no list."""
    store, path = opened(out.rstrip("/"))
    if store.get_file_info(f"{path}/{NAMES}").type == fs.FileType.NotFound:
        return None
    names = spark.read.text(f"{out.rstrip('/') if ':' in out else f'file://{path}'}/{NAMES}")
    return names.select(F.from_json("value", "array<string>").alias("name")).distinct()


def with_text(files: DataFrame, out: str, place: Callable[..., str]) -> DataFrame:
    """files, whose columns are texts, with the content of the file at the place below out that their columns give; tasks read them."""

    columns = files.columns

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(out.rstrip("/"))
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                content = []
                for names in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    with store.open_input_stream(f"{path}/{place(*names)}") as f:
                        content.append(f.read().decode())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.string())], names=[*columns, "content"])

    return files.mapInArrow(texts, ", ".join(f"{c} string" for c in [*columns, "content"]))


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, content) of the files that write_files() put under out."""
    return with_text(listed(spark, out).select(F.get("name", F.lit(0)).alias("path")), out, lambda path: path)


def write_label_files(content: DataFrame, images: DataFrame | None, out: str) -> None:
    """The label text of each sample of content (name, split, content), with its image of (name, content) if there is one, in place of what stood under out.

    A name without characters, or with a slash, fails before anything is written. Of two rows of one name and split,
    which one's file stays isn't fixed.
    """
    content.sparkSession.dataSource.register(LabelSource)
    rows = content.select("name", "split", "content")
    image = F.lit(None).cast("binary").alias("image")
    rows = rows.select("*", image) if images is None else rows.join(images.select("name", F.col("content").alias("image")), "name", "left")
    fine = F.col("name").rlike("^[^/]+$") & ~F.col("name").isin(".", "..") & F.col("split").rlike("^[^/]+$")
    rows = rows.withColumn("name", F.when(fine, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce("name", F.lit("null")))).cast("string")))
    rows.write.format("label_files").option("path", out).mode("append").save()


def read_label_files(spark: SparkSession, out: str) -> DataFrame:
    """(split, name, content) of the label files under out, those without content too, which Spark's own readers pass over.

    Their names come from the lists that the writing tasks left. In a folder without such lists, a task lists each split.
    """

    def names(batches):
        for batch in batches:
            for split in batch.columns[0].to_pylist():
                store, path = opened(out.rstrip("/"))
                found = [f.base_name.removesuffix(".txt") for f in store.get_file_info(fs.FileSelector(f"{path}/labels/{split}", allow_not_found=True)) if f.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(found), pa.string()), pa.array(found, pa.string())], names=["split", "name"])

    known = listed(spark, out)
    if known is not None:
        files = known.select(F.get("name", F.lit(0)).alias("split"), F.get("name", F.lit(1)).alias("name"))
    else:
        splits = spark.createDataFrame([("train",), ("val",), ("test",)], "split string").repartition(3, "split")
        files = splits.mapInArrow(names, "split string, name string").repartition("split", "name")
    return with_text(files, out, lambda split, name: f"labels/{split}/{name}.txt")
