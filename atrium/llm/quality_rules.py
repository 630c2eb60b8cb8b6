"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared
from .quality_stats import with_stats


@dataclass(frozen=True)
class Rule:
    """numerator / denominator in thousandths must stay within quartile -/+ reach * max(quartile distance, spread)."""

    name: str
    top: str
    bottom: str
    spread: int
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("word_length", "word_chars", "n_words", 500, low=True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 150),
    Rule("repeats", "n_repeat_words", "n_words", 100),
)
SUB = 5  # bits kept below the leading one: buckets are at most 1/32 wide


def bucket(v: Column) -> Column:
    """Bucket of a whole number in the sketch: exact below 64, then 32 buckets to each power of two."""
    shift = F.greatest(F.floor(F.log2(v + F.lit(0.5))) - SUB, F.lit(0)).cast("int")
    return shift * 1000 + F.call_function("shiftright", v, shift)


def bucket_value(b: Column) -> Column:
    """The largest whole number of a bucket."""
    shift = F.floor(b / 1000).cast("int")
    return F.call_function("shiftleft", (b % 1000).cast("long") + 1, shift) - 1


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, bucket, n) from (keys, name, v). Sketches merge by adding n, so any split of the rows gives the same."""
    return values.groupBy(*keys, "name", bucket(F.col("v")).alias("bucket")).agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, name, one column per quantile) of merged sketches. A window spans the buckets of one key, some hundreds at most."""
    w = Window.partitionBy(*keys, "name").orderBy("bucket")
    seen = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "name")))
    return seen.groupBy(*keys, "name").agg(*[F.min(F.when(F.col("upto") >= F.col("total") * q, bucket_value(F.col("bucket")))).alias(c) for c, q in at.items()])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES, reach: float = 3.0, min_words: int = 50, small_thresholds: int = 100_000) -> DataFrame:
    """Statistics, base verdict and verdict of each row against the thresholds of its own language and source.

    A null or empty text has no words and fails; a very long text counts whole; null keys are a group of their own;
    repeated rows each count and each give a row; values that tie with a threshold pass; an empty table gives an empty
    result; columns besides those named don't matter, whatever their names. The thresholds, one row per group, are
    broadcast only if at most small_thresholds.
    """
    shared = Shared(df.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    src = df.select(df[id_col].alias("__id"), *[df[k].alias(f"__k{i}") for i, k in enumerate(keys)], df[text_col].alias("__t"))
    ks = [f"__k{i}" for i in range(len(keys))]
    st = shared.put(with_stats(src, ["__id", *ks], "__t", names), "stats")
    value = lambda r: F.floor(F.col(r.top) * 1000 / F.greatest(F.col(r.bottom), F.lit(1))).cast("long")
    long = st.where("n_words > 0").select(*ks, F.explode(F.array(*[F.struct(F.lit(r.name).alias("name"), value(r).alias("v"), F.lit(1).alias("n")) for r in rules])).alias("x")).select(*ks, "x.*")
    q = quantiles(sketches(long, ks), ks, {"q1": 0.25, "q3": 0.75})
    spread = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(float(r.spread)))])
    wide = F.greatest((F.col("q3") - F.col("q1")).cast("double"), F.element_at(spread, F.col("name"))) * reach
    limits = q.withColumn("hi", F.col("q3") + wide).withColumn("lo", F.col("q1") - wide)
    one = limits.groupBy(*ks).agg(*[F.max(F.when(F.col("name") == r.name, F.col(c))).alias(f"{r.name}_{c}") for r in rules for c in ("hi", "lo")])
    one = shared.put(one.select(*[F.col(k).alias(f"{k}_r") for k in ks], *[f"{r.name}_{c}" for r in rules for c in ("hi", "lo")]), "limits")
    few = one.count() <= small_thresholds
    same = F.lit(True)
    for k in ks:
        same = same & st[k].eqNullSafe(one[f"{k}_r"])
    joined = st.join(F.broadcast(one) if few else one, same, "left")
    bad = F.lit(False)
    failed = []
    for r in rules:
        out = value(r) > F.col(f"{r.name}_hi")
        if r.low:
            out = out | (value(r) < F.col(f"{r.name}_lo"))
        out = F.coalesce(out & (F.col("n_words") > 0), F.lit(False))
        failed.append(F.when(out, F.lit(r.name)))
        bad = bad | out
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return joined.select(F.col("__id").alias(id_col), *names, base.alias("base_failed"), (~base & ~bad).alias("kept"), F.array_compact(F.array(*failed)).alias("failed_rules"))
