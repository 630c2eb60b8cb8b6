"""Exact dedup by recipes: the ordered identifiers of a text's content-defined chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, columns_of, hub_limit, map_arrow, spread_join
from .words import LOWER, text_slices

LEAST, MEAN_BITS, MOST = 512, 11, 1 << 14
WIDTH = 16  # bytes of an identifier
REACH = 32  # bytes that decide whether a chunk ends after them
_GEAR = np.random.RandomState(12).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def ends_here(data: np.ndarray) -> list[int]:
    """Places where a chunk may end: those after whose last REACH bytes the rolling hash is small."""
    h = _GEAR[data]
    width = 1
    while width < REACH:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return (np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1).tolist()


def chunk_ends(may: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the text from begin to end, of LEAST to MOST bytes, the last one of any size.

    As LEAST is more than REACH, only the text's own bytes decide, so equal texts have equal chunks wherever they stand.
    """
    out = []
    while begin < end:
        i = bisect_left(may, begin + LEAST)
        begin = min(may[i] if i < len(may) else end, begin + MOST, end)
        out.append(begin)
    return out


def identify(chunk: np.ndarray, bits: int) -> bytes:
    found = hashlib.blake2b(chunk, digest_size=WIDTH).digest()
    return found if bits >= 8 * WIDTH else (int.from_bytes(found) & ((1 << bits) - 1)).to_bytes(WIDTH)


def scan(df: DataFrame, id_col: str, text_col: str, bits: int, emit: str) -> DataFrame:
    """One pass over the texts, lower-cased in A-Z: their recipes, their chunks with the recipe's tag, or all with the text."""
    src = df.select(df[id_col].alias("doc_id"), df[text_col].alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = columns_of(batch, ["doc_id", "t"])
            for s in text_slices(texts):
                low = LOWER[s.data]
                may = ends_here(low)
                recipes, hashes, chunks, of = [], [], [], []
                for r in range(s.rows):
                    a, b = int(s.offs[r]), int(s.offs[r + 1])
                    cuts = [a, *chunk_ends(may, a, b)]
                    own = [identify(low[x:y], bits) for x, y in zip(cuts, cuts[1:], strict=False)]
                    recipes.append(b"".join(own))
                    if emit == "chunks":
                        hashes += own
                        chunks += [low[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                        of += [r] * len(own)
                tags = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), signed=True) for x in recipes], np.int64)
                if emit == "chunks":
                    yield pa.RecordBatch.from_arrays([pa.array(tags[np.array(of, np.int64)]), pa.array(hashes, pa.binary()), pa.array(chunks, pa.binary())], names=["tag", "hash", "chunk"])
                else:
                    sha = [hashlib.sha256(low[s.offs[r] : s.offs[r + 1]]).hexdigest() for r in range(s.rows)]
                    cols = [ids.slice(s.lo, s.rows), pa.array(np.arange(row, row + s.rows)), pa.array(tags), pa.array(recipes, pa.binary()), pa.array(sha, pa.string())]
                    if emit == "texts":
                        cols.append(pa.array([low[s.offs[r] : s.offs[r + 1]].tobytes() for r in range(s.rows)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "tag", "recipe", "text_sha256", "whole"][: len(cols)])
                    row += s.rows

    rows = f"doc_id {kind}, row long, tag long, recipe binary, text_sha256 string"
    return map_arrow(src, run, {"recipes": rows, "chunks": "tag long, hash binary, chunk binary", "texts": f"{rows}, whole binary"}[emit])


def ties(rows: DataFrame) -> DataFrame:
    """(recipe, tag, keep, group_size) of the recipes that several rows have; keep is the row of the largest id."""
    found = rows.groupBy("recipe").agg(F.first("tag").alias("tag"), F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return found.where("group_size > 1")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 8 * WIDTH, max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; of equal texts, but for A-Z, the largest id stays.

    A recipe is the list of a text's chunk identifiers, hashes of bits bits. Rows are grouped by recipe, so only
    recipes are moved. Where recipes tie, their chunks' bytes are brought together by identifier, each once from a
    task; an identifier with two different contents proves nothing, and the rows whose recipes hold one are compared as
    whole texts. So results don't rest on the hashes. Up to max_broadcast tags of tied recipes are broadcast to choose
    the chunks to verify; with more, all chunks are verified. A recipe that many rows have is dealt to several tasks.

    Null texts are empty texts, and those have an empty recipe. A null id is smaller than any. Of rows that repeat the
    largest id of their text one stays, which one is not fixed. Very long texts are chunked whole. An empty table gives
    an empty result. Other columns are not read.
    """
    shared = Shared(df.sparkSession)
    rows = shared.put(scan(df, id_col, text_col, bits, "recipes"), "rows")
    tied = shared.put(ties(rows), "tied")
    chunks = scan(df, id_col, text_col, bits, "chunks")
    if tied.count() <= max_broadcast:
        chunks = chunks.join(F.broadcast(tied.select("tag").distinct()), "tag", "left_semi")
    false = shared.put(chunks.select("hash", "chunk").distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "false")
    if false.limit(1).count():
        at = F.sequence(F.lit(1), F.length("recipe") - WIDTH + 1, F.lit(WIDTH))
        held = tied.where(F.length("recipe") > 0).select("recipe", "tag", F.explode(F.transform(at, lambda i: F.substring("recipe", i, F.lit(WIDTH)))).alias("hash"))
        unproven = shared.put(held.join(false, "hash", "left_semi").select("recipe", "tag").distinct(), "unproven")
        texts = scan(df, id_col, text_col, bits, "texts").join(unproven, ["recipe", "tag"], "left_semi")
        # No recipe is one byte longer than a multiple of WIDTH, so a text with its size before it and zeros behind is its own key.
        size = F.unhex(F.lpad(F.hex(F.length("whole")), 16, "0"))
        whole = F.concat(size, "whole", F.substring(F.lit(bytes(WIDTH)), 1, F.pmod(F.lit(WIDTH - 7) - F.length("whole"), F.lit(WIDTH))))
        texts = texts.withColumn("recipe", whole).withColumn("row", -1 - F.col("row")).drop("whole")
        rows = shared.put(rows.join(unproven, ["recipe", "tag"], "left_anti").unionByName(texts), "proven")
        tied = shared.put(ties(rows), "tied-again")
    joined = spread_join(rows, tied.drop("tag"), "recipe", hub_limit(rows), "left")
    alone = F.col("keep").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
    )
