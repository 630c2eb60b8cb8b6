"""URL filter: longest-prefix host rules, then association rules that FP-growth mines from labels.

Tokens that the same labelled pages hold are one item, so a run of shared tokens adds one item to a page, not many. An
item is met by any of its tokens, which is what a rule for each of them would do.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: (host, path, verdict)
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LABEL = "label:bad"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host parts, words of path and query; numbers as one token."""
    flat = lambda kind, text, cut: F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([A-Za-z]*)://", 1)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), flat("host:", host, r"\."), flat("path:", F.lower(path), r"[/._-]"), flat("query:", F.lower(query), r"[&=]")))


def prune(shared: Shared, sets: DataFrame, small: int = 10) -> DataFrame:
    """(k) of the sets (k, c, rule) that are rules and hold no smaller rule of the same or a higher confidence c.

    Rules of up to small items look up all their parts at once. Where there are longer ones, it goes level by level: the
    best confidence of a rule in or below a set is its own or that of a set with one item less. Every part of a frequent
    set is frequent, so none is missing.
    """
    largest = sets.where("rule").agg(F.max(F.size("k"))).first()[0] or 0
    if largest <= small:
        rules = sets.where("rule").select("k", "c")
        part = F.expr("explode(transform(sequence(1, shiftleft(1, size(k)) - 2), m -> filter(k, (x, i) -> (shiftright(m, i) & 1) = 1)))")
        parts = rules.where(F.size("k") > 1).select("k", "c", part.alias("p")).join(rules.select(F.col("k").alias("p"), F.col("c").alias("d")).hint("merge"), "p").where("d >= c")
        return rules.join(parts.select("k").distinct().hint("merge"), "k", "left_anti").select("k")
    parts = F.expr("transform(sequence(0, size(k) - 1), i -> concat(slice(k, 1, i), slice(k, i + 2, size(k))))")
    kept, top = [], None
    for size in range(1, largest + 1):
        level = sets.where(F.size("k") == size)
        if top is None:
            level = level.withColumn("below", F.lit(None).cast("double"))
        else:
            below = level.select("k", F.explode(parts).alias("part")).join(top.select(F.col("k").alias("part"), "top").hint("merge"), "part").groupBy("k").agg(F.max("top").alias("below"))
            level = level.join(below.hint("merge"), "k", "left")
        own = F.when(F.col("rule"), F.col("c"))
        level = shared.put(level.select("k", (F.col("rule") & (F.col("below").isNull() | (F.col("below") < F.col("c")))).alias("keep"), F.greatest(own, "below").alias("top")), f"level-{size}")
        kept.append(level.where("keep").select("k"))
        top = level.where("top is not null")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionAll(more)
    return out


@dataclass
class Mined:
    """rules: (k, anchor) over items; tokens: (token, item). The anchor is the item that the fewest pages have."""

    rules: DataFrame
    tokens: DataFrame


def least_count(n: int, min_rows: int, min_support: float) -> int:
    """How many bad pages must hold a set."""
    return max(min_rows, ceil(min_support * n), 1)


def item_table(shared: Shared, flat: DataFrame, least: int) -> DataFrame:
    """(item, n, tokens) of the tokens that enough bad pages hold, from (row, token, bad).

    Tokens in exactly the same pages are one item, told by the count and two 64-bit sums of row hashes. There are at
    most as many tokens as bad pages have on the whole, over least.
    """
    both = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    per = flat.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("hits"), *both).where(F.col("hits") >= least)
    return shared.put(per.groupBy("n", "x1", "x2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens")).select("item", "n", "tokens"), "items")


def mine(shared: Shared, flat: DataFrame, n: int, min_rows: int, min_support: float, min_confidence: float, max_broadcast: int) -> Mined | None:
    """Rules "items -> bad", or None; rules that a part of them already gives are pruned, whatever is left is given.

    flat: (row, token, bad) of n labelled pages. Frequent sets without the label are only used for counts.
    """
    least = least_count(n, min_rows, min_support)
    items = item_table(shared, flat, least)
    n_items = items.count()
    if n_items == 0:
        return None
    tokens = items.select("item", F.explode("tokens").alias("token"))
    near = F.broadcast(tokens) if n_items <= max_broadcast else tokens.hint("merge")
    pages = flat.join(near, "token").groupBy("row").agg(F.collect_set("item").alias("items"), F.max("bad").alias("bad"))
    pages = shared.put(pages.select(F.when(F.col("bad"), F.array_append("items", F.lit(LABEL))).otherwise(F.col("items")).alias("items")), "transactions")
    held = pages.count()
    sets = shared.put(FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / held), minConfidence=min_confidence).fit(pages).freqItemsets, "sets")
    key = F.array_sort(F.array_remove("items", LABEL))
    hit = sets.where(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(key.alias("k"), F.col("freq").alias("hits"))
    seen = sets.where(~F.array_contains("items", LABEL)).select(key.alias("k"), "freq")
    found = shared.put(hit.join(seen.hint("merge"), "k").select("k", (F.col("hits") / F.col("freq")).alias("c"), (F.col("hits") >= F.col("freq") * min_confidence).alias("rule")), "found")
    rules = prune(shared, found)
    anchors = rules.select("k", F.explode("k").alias("item")).join(items.select("item", "n"), "item").groupBy("k").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"))
    anchors = shared.put(anchors, "rules")
    return Mined(anchors, shared.put(tokens.join(anchors.select(F.explode("k").alias("item")).distinct(), "item"), "tokens"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", label_id: str = "page_id", rules=HOST_RULES, min_rows: int = 10, min_support: float = 0.002, min_confidence: float = 0.9, max_broadcast: int = 100_000) -> DataFrame:
    """id, host, path, rule, verdict, n_matched (mined rules that fit) of every row.

    labels (label_id, quality, toxic) mark pages by their id: one with quality 0 or toxic 1 is bad, and only labelled
    pages are learned from. Without labels, the host rules label the pages that they decide: one that a rule blocks is
    bad, one that a rule allows isn't. Mined rules carry these verdicts on to the undecided pages.
    A host rule that fits decides; else a mined rule blocks; else the page is allowed. Mined rules match by an inverted
    index from their rarest item: a rule fits if the page has its other items too. The index and the tokens are broadcast
    up to max_broadcast rows, joined by shuffle beyond.

    Null URLs have empty host and path, no tokens and no mined verdict; a very long URL is read whole; repeated rows each
    count and each give a row; of rules of equal length that fit, the last in order of (host, path) decides; a page of
    several labels is bad if one of them is; an empty table gives an empty result; other columns don't matter.
    """
    shared = Shared(pages.sparkSession)
    src = pages.select(pages[id_col].alias("__id"), pages[url_col].alias("__url")).select("__id", "__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    toks = url_tokens(F.col("host"), F.col("path"), F.col("__url"))
    keyed = shared.put(src.select("__id", "host", "path", name.alias("rule"), verdict.alias("__v"), F.when(F.col("host") != "", toks).alias("tokens"), F.monotonically_increasing_id().alias("row")), "pages")
    if labels is None:
        known = keyed.where("__v is not null").select("row", "tokens", (F.col("__v") == "block").alias("bad"))
    else:
        bad = labels.where(labels[label_id].isNotNull()).groupBy(labels[label_id].alias("__id")).agg(F.max((F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)).alias("bad"))
        known = shared.put(keyed.join(bad, "__id").select("row", "tokens", "bad"), "known")
    known = known.where("tokens is not null")
    n = known.count()
    mined = mine(shared, known.select("row", "bad", F.explode("tokens").alias("token")), n, min_rows, min_support, min_confidence, max_broadcast) if n else None
    if mined is None:
        return keyed.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__v", F.lit("allow")).alias("verdict"), F.lit(0).cast("long").alias("n_matched"))
    small = lambda df: F.broadcast(df) if df.count() <= max_broadcast else df.hint("merge")
    held = keyed.select("row", F.explode("tokens").alias("token")).join(small(mined.tokens), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    hits = held.select("row", "items", F.explode("items").alias("anchor")).join(small(mined.rules.select("anchor", "k")), "anchor")
    fits = hits.where(F.size(F.array_except("k", "items")) == 0).groupBy("row").agg(F.count("*").alias("n_matched"))
    final = F.coalesce("__v", F.when(F.col("n_matched") > 0, "block").otherwise("allow"))
    return keyed.join(fits, "row", "left").select(F.col("__id").alias(id_col), "host", "path", "rule", final.alias("verdict"), F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"))
