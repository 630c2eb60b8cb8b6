"""LM scoring: prediction by partial matching over bytes, with escape estimation and symbol exclusion, and a word unigram base.

The byte trie is learned from all training rows, to order 5 unless told otherwise. Its symbols are the 256 bytes and the
end of a text, each with a context of its own. At every order alike, a symbol that was seen after the context has its
count over (all + kinds), any other the escape, kinds over the same, times its probability one order below, where the
symbols that were seen above no longer count; below order 0 the symbols that were never seen share alike.

What was seen after a context was also seen after its suffix, so what is excluded at an order is just what was seen after
the context one longer. So an exclusion is a number for each context, and the trie is a table of grams and a table of
contexts for each order, which grow with the input: the commonest grams are broadcast, the places of all others joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, columns_of, map_arrow
from .words import LOWER, SPACED, U, Slice, mix, text_slices

BITS, END, SYMBOLS = 9, 256, 257
END_TOKEN = int(mix(np.array([0x454E44], U)).astype(np.int64)[0])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Tally:
    """Counts of 64-bit keys; parts are merged when they have grown, so memory follows the distinct keys."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.parts.append((u, n))
        self.size += len(u)
        if self.size > self.limit and len(self.parts) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(k)
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        self.parts = [(k[first], np.add.reduceat(n, first))] if len(k) else []
        self.size = len(first)
        return self.parts[0] if self.parts else (k, n)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.parts, self.size = [], 0
        return out


def count_words(df: DataFrame, flush_at: int = 2_000_000) -> DataFrame:
    """(key, n) of (t): how often each word is met, by hash, and one end for each row, in parts that are yet to be added up."""

    def run(batches):
        words, ends = Tally(), 0
        rec = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])
        for batch in batches:
            ends += batch.num_rows
            for s in text_slices(columns_of(batch, ["t"])[0], 4 << 20):
                words.add(s.split(SPACED).hashes(lower=True).astype(np.int64))
                if words.size > flush_at:
                    yield rec(*words.flush())
        yield rec(*words.flush())
        yield rec(np.array([END_TOKEN]), np.array([ends]))

    return map_arrow(df, run, "key long, n long").where("n > 0")


def codes(s: Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of each byte and of the end of each row, BITS a symbol, and the rows' bounds in them."""
    lens = np.diff(s.offs)
    n = len(s.data) + order * (s.rows + 1)
    arr = np.full(n, END, np.int64)
    at = np.arange(len(s.data)) + np.repeat(order * (np.arange(s.rows) + 1), lens)
    arr[at] = LOWER[s.data]
    full = arr[: n - order].copy()
    for j in range(1, order + 1):
        full <<= BITS
        full |= arr[j : n - order + j]
    keep = np.ones(len(full), bool)  # but for the further ends after each row, which are padding
    stops = s.offs[1:] + order * np.arange(s.rows)
    for j in range(1, order):
        keep[stops + j] = False
    return full[keep], s.offs + np.arange(s.rows + 1)


def count_grams(df: DataFrame, order: int, flush_at: int = 1_500_000) -> DataFrame:
    """(gram, n) of (t): how often each symbol follows the ones before it, in parts that are yet to be added up."""

    def run(batches):
        grams = Tally(1_000_000)

        def parts():
            k, n = grams.flush()
            for lo in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 200_000], pa.int64()), pa.array(n[lo : lo + 200_000], pa.int64())], names=["gram", "n"])

        for batch in batches:
            for s in text_slices(columns_of(batch, ["t"])[0]):
                grams.add(codes(s, order)[0])
                if grams.size > flush_at:
                    yield from parts()
        yield from parts()

    return map_arrow(df, run, "gram long, n long")


def last(c: str, symbols: int) -> Column:
    """The last symbols of a gram or context."""
    return F.col(c).bitwiseAND((1 << BITS * symbols) - 1)


def context() -> Column:
    return F.shiftright("gram", BITS)


def most_frequent(counts: DataFrame, most: int) -> Column:
    """Whether n reaches the least count, rounded down to a power of 2**(1/8), that at most so many rows reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r.b, r.m) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("m")).collect()), reverse=True)
    room, least = most, 10**6
    for b, m in levels:
        if m > room:
            break
        room, least = room - m, b
    return step >= least


@dataclass
class Trie:
    """grams[k]: (gram, n) of k + 1 symbols. contexts[k]: (ctx, t, kinds) and what follows from them.

    first_den, first_esc: divisor of the counts and log10 of the escape where the context is the longest that was seen;
    next_den, next_esc: those of its suffix, where what was seen after this context doesn't count.
    """

    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    order: int

    def shares(self) -> DataFrame:
        """(gram, n, lp) of the longest grams: log10 probability of a symbol that was seen after its whole context."""
        both = self.grams[self.order].withColumn("ctx", context()).join(self.contexts[self.order].select("ctx", "first_den"), "ctx")
        return both.select("gram", "n", F.log10(F.col("n") / F.col("first_den")).alias("lp"))

    def values(self, grams: DataFrame) -> DataFrame:
        """(gram, value): log10 probability of the last symbol of each distinct gram, whether or not it was seen.

        From order 0 up: value is that of the symbol after the context so far, below the same one order lower without
        what was seen after this context. Tables of orders 0 and 1 have at most 257 and 257 * 257 rows.
        """
        out = grams.select("gram", F.lit(-float(np.log10(SYMBOLS))).alias("value"), F.lit(None).cast("double").alias("below"), F.lit(None).cast("long").alias("m"))
        for k in range(self.order + 1):
            small = F.broadcast if k <= 1 else lambda df: df
            out = out.withColumn("low", last("gram", k + 1)).withColumn("ctx", F.shiftright("low", BITS))
            out = out.join(small(self.grams[k].select(F.col("gram").alias("low"), "n")), "low", "left")
            out = out.join(small(self.contexts[k].select("ctx", "first_den", "first_esc", "next_den", "next_esc")), "ctx", "left")
            below = F.col("next_esc") if k == 0 else F.coalesce(F.log10(F.try_divide("m", "next_den")), F.col("next_esc") + F.col("below"))
            value = F.coalesce(F.log10(F.col("n") / F.col("first_den")), F.col("first_esc") + below)
            known = F.col("first_den").isNotNull()
            out = out.select("gram", F.when(known, value).otherwise(F.col("value")).alias("value"), F.when(known, below).alias("below"), F.col("n").alias("m"))
        return out.select("gram", "value")


def escape(seen: Column, kinds: Column) -> Column:
    """log10 of the share of what was not seen; 1 where nothing is left that was seen."""
    return F.when(kinds > 0, F.log10(F.try_divide(kinds, seen + kinds))).otherwise(F.lit(0.0))


def learn(shared: Shared, counts: DataFrame, order: int) -> Trie:
    """The trie from parts of the counts of its longest grams, (gram, n)."""
    summed = lambda df, k: df.groupBy(last("gram", k + 1).alias("gram")).agg(F.sum("n").alias("n"))
    trie = Trie({order: shared.put(summed(counts, order), f"grams-{order}")}, {}, order)
    for k in range(order - 1, -1, -1):
        trie.grams[k] = shared.put(summed(trie.grams[k + 1], k), f"grams-{k}")
    for k in range(order + 1):
        own = trie.grams[k].withColumn("ctx", context())
        if k == 0:
            by = own.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("kinds"))
            rest = by.withColumn("seen", F.lit(0)).withColumn("left", F.lit(0))  # what was never seen shares alike
            low_den, low_esc = F.lit(None).cast("double"), -F.log10(F.greatest(SYMBOLS - F.col("kinds"), F.lit(1)))
        else:
            low = trie.grams[k - 1].select(F.col("gram").alias("low"), F.col("n").alias("m"))
            met = own.withColumn("low", last("gram", k)).join(F.broadcast(low) if k == 1 else low, "low")
            by = met.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("kinds"), F.sum("m").alias("r"))
            under = trie.contexts[k - 1].select(F.col("ctx").alias("suffix"), F.col("t").alias("t0"), F.col("kinds").alias("kinds0"))
            rest = by.withColumn("suffix", last("ctx", k - 1)).join(F.broadcast(under) if k <= 2 else under, "suffix")
            rest = rest.withColumn("seen", F.col("t0") - F.col("r")).withColumn("left", F.when(F.col("kinds0") < SYMBOLS, F.col("kinds0") - F.col("kinds")).otherwise(0))
            low_den, low_esc = (F.col("seen") + F.col("left")).cast("double"), escape(F.col("seen"), F.col("left"))
        kinds = F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)  # none left to escape to
        found = rest.select("ctx", "t", "kinds", (F.col("t") + kinds).cast("double").alias("first_den"), escape(F.col("t"), kinds).alias("first_esc"), low_den.alias("next_den"), low_esc.alias("next_esc"))
        trie.contexts[k] = shared.put(found, f"contexts-{k}")
    return trie


@dataclass
class Model:
    grams: np.ndarray  # the common grams, sorted
    shares: np.ndarray  # and their log10 probabilities
    known: np.ndarray  # sorted hashes of the common words
    counts: np.ndarray
    start: np.ndarray  # where each 20-bit prefix begins in known
    tokens: int
    kinds: int

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Counts of the words in the common table, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        b = (h >> U(44)).astype(np.int64)
        at, end = self.start[b], self.start[b + 1]
        live = np.flatnonzero(at < end)
        at, end, want = at[live], end[live], h[live]
        while len(live):
            hit = self.known[at] == want
            out[live[hit]] = self.counts[at[hit]]
            go = ~hit & (at + 1 < end)
            live, at, end, want = live[go], at[go] + 1, end[go], want[go]
        return out

    def gram_shares(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of the grams in the common table, 0 for others, and which are in it."""
        kinds, which = np.unique(g, return_inverse=True)
        at = np.searchsorted(self.grams, kinds)
        at[at == len(self.grams)] = 0
        hit = self.grams[at] == kinds if len(self.grams) else np.zeros(len(kinds), bool)
        value = np.where(hit, self.shares[at], 0.0) if len(self.grams) else np.zeros(len(kinds))
        return value[which], hit[which]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_common: int = 500_000, order: int = 5, max_grams: int = 1_500_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows that aren't held out.

    Counts of words and grams cover all training rows. The most frequent words and grams, at most max_common and
    max_grams, are broadcast; the places of all others are joined with the rest by shuffle, once for each row and gram,
    so nothing is left out and neither bound alters a result. order is 1 to 6: a gram is 9 bits for each symbol.

    Null and empty texts have the end alone; a very long text is read in slices but for its own; with nothing to learn
    from, all counts are 0, the base score falls back on its constant and every symbol has one share; repeated rows each
    count and each give a row, and ties in frequency are broadcast together or not at all; an empty table gives an empty
    result; other columns don't matter.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be in 1 to 6")
    spark, shared = df.sparkSession, Shared(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("t")).withColumn("held", held_out(F.col("id")))
    train = src.where("not held").select("t")
    words = shared.put(count_words(train).groupBy("key").agg(F.sum("n").alias("n")), "tally")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    trie = learn(shared, count_grams(train, order), order)
    shares = shared.put(trie.shares(), "shares")
    top = shares.where(most_frequent(shares, max_grams)).select("gram", "lp").sort("gram").toArrow()
    often = most_frequent(words, max_common) | (F.col("key") == END_TOKEN)
    common = words.where(often).select("key", "n").toArrow()
    keys = common.column("key").to_numpy().astype(U)
    by_key = np.argsort(keys)
    keys = keys[by_key]
    start = np.searchsorted(keys, np.arange(2**20 + 1, dtype=U) << U(44)) if len(keys) else np.zeros(2**20 + 1, np.int64)
    start[-1] = len(keys)
    model = spark.sparkContext.broadcast(Model(top.column("gram").to_numpy(), top.column("lp").to_numpy(), keys, common.column("n").to_numpy()[by_key], start.astype(np.int32), int(total), int(kinds)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = model.value
        row, end_c = TaskContext.get().partitionId() << 36, int(m.lookup(np.array([END_TOKEN]).astype(U))[0])
        for batch in batches:
            ids, helds, texts = columns_of(batch, ["id", "held", "t"])
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
            tails, tail_n, novel, novel_n, times = [], [], [], [], []
            for s in text_slices(texts):
                h = s.split(SPACED).hashes(lower=True)
                c = m.lookup(h)
                found = c >= 0
                sums = lambda x, b=s.bounds: np.diff(np.concatenate(([0], np.cumsum(x)))[b])
                n_found = sums(found)
                ends = max(end_c, 0)
                out["n_tokens"].append(s.counts + 1)
                out["n_known"].append(n_found + (ends > 0))
                out["base"].append(sums(np.where(found, m.base(np.maximum(c, 0)), 0.0)) + m.base(np.array([ends]))[0])
                tails.append(h[~found].astype(np.int64))
                tail_n.append(s.counts - n_found)
                g, bounds = codes(s, order)
                value, hit = m.gram_shares(g)
                bits = np.concatenate(([0.0], np.cumsum(value)))
                out["score"].append(np.diff(bits[bounds]))
                new, of = g[~hit], np.repeat(np.arange(s.rows), np.diff(bounds))[~hit]
                order_by = np.lexsort((new, of))
                new, of = new[order_by], of[order_by]
                one = np.flatnonzero(np.concatenate((np.ones(min(len(new), 1), bool), (new[1:] != new[:-1]) | (of[1:] != of[:-1]))))
                novel.append(new[one])
                times.append(np.diff(np.append(one, len(new))))
                novel_n.append(np.bincount(of[one], minlength=s.rows))
            cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cat(k, np.int64)))).astype(np.int32)), pa.array(cat(x, np.int64)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n), pa.int64()), ids, helds, *(pa.array(cat(out[k], np.int64)) for k in ("n_tokens", "n_known")), *(pa.array(cat(out[k], float)) for k in ("base", "score")), lists(tails, tail_n), lists(novel, novel_n), lists(times, novel_n)], names=["row", "id", "held", "n_tokens", "n_known", "base", "score", "tail", "novel", "times"])
            row += n

    rows = shared.put(map_arrow(src, run, f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double, tail array<long>, novel array<long>, times array<long>"), "rows")
    rare = words.where(~often).select("key", "n")
    tail = rows.select("row", F.explode("tail").alias("key")).join(rare, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cost = F.log10((F.col("n") + 0.1) / F.lit(float(total) + 0.1 * (kinds + 1)))
    tail = tail.groupBy("row").agg(F.sum(cost).alias("more"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("known"))
    novel = rows.select("row", F.inline(F.arrays_zip(F.col("novel").alias("gram"), F.col("times").alias("times"))))
    # A gram that was seen has its share; only those that weren't go down the orders.
    met = shared.put(novel.select("gram").distinct().join(shares.select("gram", "lp"), "gram", "left"), "met")
    unseen = shared.put(trie.values(met.where("lp is null").select("gram")), "unseen")
    value = met.where("lp is not null").select("gram", F.col("lp").alias("value")).unionAll(unseen)
    novel = novel.join(value, "gram").groupBy("row").agg(F.sum(F.col("value") * F.col("times")).alias("bits"))
    out = rows.drop("tail", "novel", "times").join(tail, "row", "left").join(novel, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("bits", F.lit(0.0))).alias("score"))
