"""Benchmark decontamination with DataFrame functions only: a broadcast set of item windows, scanned and verified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, free_name

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), F.lit(f"({WORD})"), F.lit(1))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(size, win, items): each distinct window of item words and the items that have it; a shorter item is one window."""
    w = benchmark.select(benchmark[id_col].cast("string").alias("item"), words(benchmark[text_col]).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(n))
    starts = w.select("item", "w", k.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("i"))
    return starts.select("item", "size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("win")).groupBy("size", "win").agg(F.collect_set("item").alias("items"))


def opening(w: Column, i: Column) -> Column:
    """Hash of the word at i (from 0) and the next one."""
    return F.xxhash64(F.get(w, i), F.get(w, i + 1))


def candidates(shared: Shared, keyed: DataFrame, hashes: DataFrame, name: str, of: Callable[[Column], Column], least: int, max_openings: int) -> DataFrame:
    """(__row, name): the places of a row's words whose hash is one of hashes. Only places and hashes leave the rows, and only where the hashes are too many to broadcast are they shuffled."""
    known = shared.put(hashes.distinct(), f"hashes-{name}")
    at = F.when(F.size("w") >= least, F.transform(F.sequence(F.lit(0), F.size("w") - least), lambda i: F.struct(i.alias("i"), of(i).alias("h"))))
    places = keyed.select("__row", F.inline(at))
    hit = places.join(F.broadcast(known) if known.count() <= max_openings else known, "h", "left_semi")
    return shared.put(hit.groupBy("__row").agg(F.array_sort(F.collect_list("i")).alias(name)), name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, max_broadcast: int = 200_000, max_openings: int = 5_000_000) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and hits (array of start, size) for every row.

    The item windows are broadcast behind a check of their number; their opening word pairs are a hash set inside the
    scan, which leaves a few places per document to verify by the whole window's text. Beyond max_broadcast windows,
    places are joined with the opening pairs, which are broadcast up to max_openings and shuffled beyond, and the
    windows at the places that are left with the items' by shuffle. No bound alters the result.

    Null and empty texts have no words; items without words have no window; null item ids are not counted; a very long
    text is scanned whole; of equal windows in several items each item counts; repeated rows each give a row; empty
    tables give empty or clean results; other columns don't matter. Rows travel by an internal key, so repeated ids
    don't mix.
    """
    shared = Shared(docs.sparkSession)
    wins = shared.put(item_windows(benchmark.where(benchmark[item_id].isNotNull()), item_id, item_text, n), "windows")
    n_wins = wins.count()
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())
    base = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__t"))
    scanned = base.select("__id", words(F.col("__t")).alias("w"))
    few = n_wins <= max_broadcast
    if not sizes:
        none = F.array().cast("array<struct<start:int,size:int>>")
        return scanned.select(F.col("__id").alias(id_col), F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), none.alias("hits"))
    first = F.split("win", " ")

    def piece(k: int) -> Column:
        """Every place with k words left, as a candidate; a lambda of two parameters would be given the index."""
        fits = F.filter(F.col("at1" if k == 1 else "at2"), lambda i: i + k <= F.size("w"))
        return F.transform(fits, lambda i: F.struct(i.alias("start"), F.lit(k).alias("size"), F.array_join(F.slice(F.col("w"), i + 1, F.lit(k)), " ").alias("win")))

    if few:
        opens = [r.h for r in wins.where("size > 1").select(F.xxhash64(F.get(first, F.lit(0)), F.get(first, F.lit(1))).alias("h")).distinct().collect()]
        lone = [r.h for r in wins.where("size = 1").select(F.xxhash64("win").alias("h")).collect()]
        last = F.size("w") - 1
        at = lambda test, upto: F.when(F.size("w") > upto, F.filter(F.sequence(F.lit(0), F.greatest(last - upto, F.lit(0))), test)).otherwise(F.array().cast("array<int>"))
        places = scanned.select("__id", "w", at(lambda i: opening(F.col("w"), i).isin(opens), 1).alias("at2"), (at(lambda i: F.xxhash64(F.get(F.col("w"), i)).isin(lone), 0) if lone else F.array().cast("array<int>")).alias("at1"))
        pieces = [piece(k) for k in sizes]
        # Most openings are chance; the hash of the whole window leaves those that will be verified.
        full = [r.h for r in wins.select(F.xxhash64("win").alias("h")).collect()]
        checked = places.select("__id", F.size("w").alias("n_words"), F.filter(F.concat(*pieces), lambda x: F.xxhash64(x["win"]).isin(full)).alias("cand"))
        # Long documents with hits are cut to their hits before anything is shuffled.
        keyed = checked.withColumn("__row", F.monotonically_increasing_id())
        keyed = shared.put(keyed, "scanned")
        found = keyed.where(F.size("cand") > 0).select("__row", F.explode("cand").alias("c")).select("__row", "c.start", "c.size", "c.win").join(F.broadcast(wins), ["size", "win"])
    else:
        keyed = shared.put(scanned.withColumn("__row", F.monotonically_increasing_id()).withColumn("n_words", F.size("w")), "scanned")
        starts = [candidates(shared, keyed, wins.where("size > 1").select(opening(first, F.lit(0)).alias("h")), "at2", lambda i: opening(F.col("w"), i), 2, max_openings)]
        if 1 in sizes:
            starts.append(candidates(shared, keyed, wins.where("size = 1").select(F.xxhash64("win").alias("h")), "at1", lambda i: F.xxhash64(F.get("w", i)), 1, max_openings))
        near = keyed.select("__row", "w").join(starts[0], "__row", "left" if len(starts) > 1 else "inner")
        for more in starts[1:]:
            near = near.join(more, "__row", "left")
        pieces = [piece(k) for k in sizes]
        none = F.array().cast("array<struct<start:int,size:int,win:string>>")
        found = near.select("__row", F.explode(F.concat(*[F.coalesce(x, none) for x in pieces])).alias("c")).select("__row", "c.start", "c.size", "c.win").join(wins, ["size", "win"])
    per = found.groupBy("__row").agg(F.collect_set(F.struct("start", "size")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))
    per = per.select("__row", F.array_sort("hits").alias("hits"), covered.alias("n_hit"), F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("sha"))
    out = keyed.select("__row", "__id", "n_words").join(per, "__row", "left")
    return out.select(F.col("__id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 200_000, **args) -> DataFrame:
    """The rows of docs without a benchmark window. The flags are joined back on id and text hash, so repeated ids keep their own verdict.

    The keys of contaminated rows are written and counted; up to max_broadcast_rows they are broadcast, so no text is
    shuffled; beyond, both sides are. Null and empty texts have no windows and stay; very long texts count whole; rows
    that repeat id and text go or stay together; an empty table gives an empty result; columns may have any names.
    """
    mark, key = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), free_name(docs, "__key")
    tagged = docs.withColumn(key, F.struct(docs[id_col].alias("i"), mark.alias("h")))
    bad = decontaminate(tagged.select(key, text_col), benchmark, key, text_col, **args).where("contaminated").select(key).distinct()
    bad = Shared(docs.sparkSession).put(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= max_broadcast_rows else bad
    return tagged.join(bad, tagged[key].eqNullSafe(bad[key]), "left_anti").drop(key)
