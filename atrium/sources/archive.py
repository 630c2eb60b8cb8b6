"""A deflated archive whose entries are packed by tasks; the driver only lays their places."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from .files import entries

#: Fixed values of the format: signatures, the version that reads deflated entries and large archives, and names in UTF-8.
LOCAL, CENTRAL, END, END_LARGE, LOCATE_LARGE = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
VERSION, UTF8, DEFLATED, FIRST_DAY = 45, 0x800, 8, 0x21
MOST, MANY = 0xFFFFFFFF, 0xFFFF


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, crc, size, small, body): header and deflated content of each (entry, content); an empty content is one too."""
    for batch in batches:
        rows = []
        for entry, content in zip(batch.columns[0].to_pylist(), batch.columns[1], strict=True):
            content = content.as_py() or b""
            press = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = press.compress(content) + press.flush()
            if max(len(data), len(content)) >= MOST:
                raise ValueError(f"{entry} is too large for a row")
            name, crc = entry.encode(), zlib.crc32(content)
            head = LOCAL + struct.pack("<HHHHHIIIHH", VERSION, UTF8, DEFLATED, 0, FIRST_DAY, crc, len(data), len(content), len(name), 0) + name
            rows.append((entry, crc, len(content), len(data), head + data))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["entry", "crc", "size", "small", "body"])


def directory_entry(entry: str, crc: int, size: int, small: int, at: int) -> bytes:
    name = entry.encode()
    large = struct.pack("<HHQ", 1, 8, at) if at >= MOST else b""
    return CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", VERSION, VERSION, UTF8, DEFLATED, 0, FIRST_DAY, crc, small, size, len(name), len(large), 0, 0, 0, 0, min(at, MOST)) + name + large


def end_of(count: int, size: int, at: int) -> bytes:
    """The records after a directory of so many entries and bytes that begins at a place; the large form where one is needed."""
    large = b""
    if count >= MANY or size >= MOST or at >= MOST:
        large = END_LARGE + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, count, count, size, at) + LOCATE_LARGE + struct.pack("<IQI", 0, at + size, 1)
    return large + END + struct.pack("<HHHHIIH", 0, 0, min(count, MANY), min(count, MANY), min(size, MOST), min(at, MOST), 0)


def archive(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """(place, part): the pieces of an archive of (path, content), which are the file when put together in order of place.

    Entries are in order of name, without what archives leave out (entries()). Each is deflated in a task and written,
    with its place in the order; where it begins is the sum of the sizes before it, which are summed by blocks of 10,000
    places, so neither the driver nor one task sees more than a number for each block. The directory is a piece for each
    block too, and the end of the file is the last one. Paths that give one name are several entries of that name.
    """
    rows = entries(files, root, prefix).select("entry", "content").mapInArrow(packed, "entry string, crc long, size long, small long, body binary")
    rows = global_rank(rows, "entry").withColumn("block", F.floor(F.col("rank") / 10_000))
    blocks = rows.groupBy("block").agg(F.sum(F.length("body").cast("long")).alias("bytes"), F.count("*").alias("n"))
    before, count, begins = 0, 0, []
    for b, n, size in sorted((r.block, r.n, r.bytes) for r in blocks.collect()):
        begins.append((b, before))
        before, count = before + size, count + n
    begin = files.sparkSession.createDataFrame(begins, "block long, begin long")
    over = Window.partitionBy("block").orderBy("rank")
    rows = rows.join(F.broadcast(begin), "block").withColumn("at", F.col("begin") + F.sum(F.length("body").cast("long")).over(over) - F.length("body"))

    @F.pandas_udf("binary")
    def directory(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda items: b"".join(directory_entry(i["entry"], i["crc"], i["size"], i["small"], i["at"]) for i in items))

    items = F.array_sort(F.collect_list(F.struct("at", "entry", "crc", "size", "small")))  # of a block
    listed = rows.groupBy("block").agg(items.alias("items")).select("block", directory("items").alias("part"))
    size = listed.agg(F.sum(F.length("part").cast("long"))).first()[0] or 0
    last = files.sparkSession.range(1).select(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(end_of(count, size, before)).alias("part"))
    pieces = rows.select(F.lit(0).alias("kind"), F.col("rank").alias("at"), F.col("body").alias("part")).unionByName(listed.select(F.lit(1).alias("kind"), F.col("block").alias("at"), "part")).unionByName(last)
    return pieces.select(F.struct("kind", "at").alias("place"), "part")
