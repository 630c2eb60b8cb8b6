"""How filters interact: what each of five removes, repeats and loses in every order of applying them."""

from __future__ import annotations

import hashlib
import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, columns_of, hub_limit, map_arrow, spread_join
from .quality_stats import NOT_TAIL, UPPER, byte_set
from .words import SPACED, Slice, text_slices, verified_distinct

FILTERS = "ABCDE"
SYMBOLS = byte_set(b"#$%&*|")

#: Every order of the filters and step of it: the step's filter and those before it, as bits of a document's mask.
STEPS = [(o, i + 1, 1 << FILTERS.index(c), sum(1 << FILTERS.index(b) for b in o[:i])) for o in map("".join, permutations(FILTERS)) for i, c in enumerate(o)]


def failed(s: Slice) -> np.ndarray:
    """A mask of each row of the slice: 1 few words, 2 few different words, 4 many capitals, 8 a symbol."""
    s.split(SPACED)
    words, points = s.counts, s.per_row(NOT_TAIL[s.data])
    distinct = verified_distinct(s, s.hashes())
    capitals, symbols = s.per_row(UPPER[s.data]), s.per_row(SYMBOLS[s.data])
    return (words < 200) | (100 * distinct < 50 * words) * 2 | (100 * capitals > 3 * points) * 4 | (symbols > 0) * 8


def document_masks(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, mask, digest) of every row: the filters that its text fails on its own, and the text's SHA-256. No shuffle."""
    src = df.select(df[order_col].alias("doc_id"), F.coalesce(df[lang_col], F.lit("")).alias("part"), df[text_col].alias("t"))

    def run(batches):
        for batch in batches:
            ids, part, texts = columns_of(batch, ["doc_id", "part", "t"])
            for s in text_slices(texts):
                digests = [hashlib.sha256(s.data[s.offs[r] : s.offs[r + 1]]).digest() for r in range(s.rows)]
                cols = [ids.slice(s.lo, s.rows), part.slice(s.lo, s.rows), pa.array(failed(s), pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "mask", "digest"])

    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def mask_counts(df: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which filters, 16 being the text of a smaller id.

    Only ids, masks and digests are shuffled. Copies of a text are counted before they meet, and an id that many rows
    share, or none (null), is dealt to several tasks.
    """
    shared = Shared(df.sparkSession)
    texts = shared.put(document_masks(df, text_col, lang_col, order_col).groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n")), "texts")
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic"))
    named = texts.where("doc_id is not null")
    marked = spread_join(named, marks, "doc_id", hub_limit(named), "left").unionByName(texts.where("doc_id is null"), allowMissingColumns=True)
    # A text's first id may stand in several rows; all of them pass the last filter, and so do rows without an id.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = marked.groupBy("digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label of one text
    passed = groups.withColumn("passed", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    return passed.select("part", "good", "toxic", F.inline(both)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def filter_audit(df: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """A row for each part (value of lang_col), order of the five filters and step of it; see STEPS.

    Filters: A under 200 words; B fewer than half as many different words; C more than 3 capitals in 100 characters;
    D a symbol of #$%&*|; E the text of a smaller id anywhere in the table. Texts are scanned once, as Arrow buffers;
    what is left of a part is a count for each of 32 masks, and all 600 rows follow from those.

    Null texts are empty texts; null and empty parts are one; a null id is no smaller and no larger than any, so its row
    passes E. Rows that repeat an id count each, and pass E together. A label without a document, or without a value,
    counts for nothing; of several for one id any 1 counts. Very long texts are scanned whole. An empty table gives no
    rows. Other columns are not read.
    """
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s, strict=True)) for s in STEPS])), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = mask_counts(df, labels, text_col, lang_col, order_col).select("*", F.inline(steps))
    bits = lambda c: F.col("mask").bitwiseAND(F.col(c))
    there, fails = bits("before") == 0, bits("bit") != 0
    count = lambda which, n=F.col("n"): F.sum(F.when(which, n).otherwise(0)).cast("long")
    # Of k filters that a document fails each comes first in 120 / k of the orders.
    return rows.groupBy("part", "filter_order", "step").agg(
        count(there & ~fails).alias("kept"),
        count(there & fails).alias("removed"),
        count(~there & fails).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(there & fails & F.col("good")).alias("good_lost"),
        count(there & fails & F.col("toxic")).alias("toxic_lost"),
        count(fails, F.expr("n * (120 div bit_count(mask))")).alias("shapley"),
    )
