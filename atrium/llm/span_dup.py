"""Substring dedup by sliding sentence spans: a span that was seen before loses its sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, columns_of, hub_limit, map_arrow
from .words import SPACED, U, mix, span_hashes, text_slices

_M = 0x9E3779B97F4A7C15

#: A sentence ends with its stops or line breaks and the blanks after them; the last one with the text.
SENTENCE = re.compile(rb"[^.!?\n]*[.!?\n][.!?\s]*|[^.!?\n]+\Z")


def sentences(data: bytes) -> np.ndarray:
    """Ends of the sentences; each begins where the one before ends, so together they are the text."""
    return np.array([m.end() for m in SENTENCE.finditer(data)], np.int64)


def word_begins(data: np.ndarray) -> np.ndarray:
    """The bytes that begin a word; each Han or Kana character is a word, as no blanks part them."""
    is_word = SPACED[data]
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    if len(data) < 3:
        return opens
    two = data[:-2].astype(np.int32) << 8 | data[1:-1]
    at = np.flatnonzero((two >= 0xE381) & (two <= 0xE383) | (two >= 0xE390) & (two <= 0xE9BF) & (two != 0xE4B7) | (two >= 0xEFA4) & (two <= 0xEFAB) | (two >= 0xF0A0) & (two <= 0xF0BF))
    after = at + np.where(data[at] == 0xF0, 4, 3)
    after = after[after < len(data)]
    opens[after] |= is_word[after]
    opens[at] = True
    return opens


def grown(h: np.ndarray, upto: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each start whose run sentences have too few words, the shortest longer run that has min_words. (hashes, starts, sizes)"""
    n = h.shape[1]
    at = np.arange(max(0, n - run))
    at = at[upto[at + run] - upto[at] < min_words]
    end = np.searchsorted(upto, upto[at] + min_words)
    at, end = at[end <= n], end[end <= n]
    if not len(at):
        return np.zeros((2, 0), U), *(np.zeros(0, np.int64),) * 2
    down, up = np.full(n, pow(_M, -1, 1 << 64), U), np.full(n, _M, U)
    down[0] = up[0] = 1
    total = np.concatenate((np.zeros((2, 1), U), np.cumsum(mix(h) * np.cumprod(down), axis=1)), axis=1)
    return mix((total[:, end] - total[:, at]) * np.cumprod(up)[at] + (end - at).astype(U)), at, end - at


def spans_of(data: np.ndarray, run: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(128-bit hashes as two rows, first sentence, sentences) of the spans of one text, and its number of sentences.

    A span is run consecutive sentences; where those have fewer than min_words words, the shortest longer run that has
    them; and fewer sentences of long_words or more. So every run is in a span, but for the last ones of a text that
    have too few words. Blanks around a sentence don't count.
    """
    ends = sentences(data.tobytes())
    n = len(ends)
    if not n:
        return np.zeros((2, 0), U), *(np.zeros(0, np.int64),) * 2, 0
    begins = np.concatenate(([0], ends[:-1]))
    solid = np.flatnonzero(SPACED[data])
    lo, hi = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
    some = hi > lo
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[some], last[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    h = span_hashes(data, first, last, wide=True)
    upto = np.concatenate(([0], np.cumsum(word_begins(data))))[np.concatenate(([0], ends))]
    out = []
    g = h.copy()
    for size in range(1, min(run, n) + 1):
        m = n - size + 1
        if size > 1:
            g = mix(g[:, :m] * U(_M) + h[:, size - 1 :] + U(size))
        at = np.flatnonzero(upto[size:] - upto[:m] >= (min_words if size == run else long_words))
        out.append((g[:, at], at, np.full(len(at), size)))
    out.append(grown(h, upto, run, min_words))
    return *(np.concatenate(x, axis=-1) for x in zip(*out, strict=True)), n


def covered(first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The same sentences as runs that don't touch, (first, size) in order."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate((first + size)[order])
    new = np.append(True, a[1:] > b[:-1])
    begin, end = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    return list(zip(begin.tolist(), (end - begin).tolist(), strict=True))


def hot_cuts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(row, i, size): the sentences of each row that spans of hot (a, b, row0, i0) cover elsewhere than at their first place.

    hot has few rows (see hub_limit), which every task holds sorted, so a span in a third of all rows meets in no shuffle
    and gives a row of runs, not a row for each place.
    """
    # At most 10,000 spans, so no more than 320 KB.
    known = np.array([tuple(r) for r in hot.select("a", "b", "row0", "i0").collect()], np.int64).reshape(-1, 4)
    given = rows.sparkSession.sparkContext.broadcast(known[np.argsort(known[:, 0], kind="stable")])

    def find(batches):
        keys = given.value
        for batch in batches:
            ids, lists = columns_of(batch, ["row", "spans"])
            flat = lists.flatten()
            a, b, i, size = (np.asarray(flat.field(k)).astype(np.int64) for k in ("a", "b", "i", "size"))
            row = np.repeat(np.asarray(ids), np.diff(np.asarray(lists.offsets)))
            lo, hi = np.searchsorted(keys[:, 0], a, "left"), np.searchsorted(keys[:, 0], a, "right")
            again = np.zeros(len(a), bool)
            for step in range(int((hi - lo).max(initial=0))):  # spans that share half of their hash
                at = np.minimum(lo + step, len(keys) - 1)
                again |= (lo + step < hi) & (keys[at, 1] == b) & ((keys[at, 2] != row) | (keys[at, 3] != i))
            out = []
            at = np.flatnonzero(again)
            for part in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else []:
                out += [(int(row[part[0]]), *run) for run in covered(i[part], size[part])]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["row", "i", "size"])

    return map_arrow(rows.select("row", "spans"), find, "row long, i int, size int")


def cut_spans(text: str, cut: list[dict]) -> tuple[str, int, int]:
    """The text without the sentences of the spans, how many went, and their words."""
    data = text.encode()
    ends = sentences(data)
    steps = np.zeros(len(ends) + 1, np.int64)
    for c in cut:
        steps[c["i"]] += 1
        steps[c["i"] + c["size"]] -= 1
    drop = np.cumsum(steps[:-1]) > 0
    begins = np.concatenate(([0], ends[:-1]))
    gone = [data[a:b] for a, b, d in zip(begins, ends, drop, strict=True) if d]
    left = b"".join(data[a:b] for a, b, d in zip(begins, ends, drop, strict=True) if not d)
    return left.decode(), len(gone), len(b" ".join(gone).split())


def span_dedup(df: DataFrame, keep: list[str], order_col: str = "doc_id", text_col: str = "text", run: int = 3, min_words: int = 8, long_words: int = 30) -> DataFrame:
    """The kept columns, text without repeated spans, n_sentences, n_removed and words_removed of every row.

    Of equal spans (see spans_of()) anywhere in the table, the one in the row of least order_col (null last), then the
    earliest place, is the first; sentences that any other one covers go. Counting is a group-by with partial sums. The
    places of repeated spans are found by a join, but for spans of more places than hub_limit, of which there are at most
    10,000: those are broadcast (hot_cuts), so a passage that a third of all rows hold is no single task and its places
    are no rows. Texts are written once with their spans and shuffled once; only those that lose
    sentences are handled in Python after that.

    Null texts stay null; texts without sentences stay as they are; a very long text is handled whole; rows that repeat
    an order_col value, whole rows included, are still several rows, and all but one lose their spans, which one is not
    fixed; an empty table gives an empty result; kept columns named like the result's own are replaced by those.
    """
    shared = Shared(df.sparkSession)
    keep = [c for c in keep if c not in ("n_sentences", "n_removed", "words_removed")]
    names = [c for c in keep if c != text_col]
    inner = [f"k{i}" for i in range(len(names))]
    kinds = [df.schema[c].dataType.simpleString() for c in names]
    src = df.select(*[df[c].alias(k) for c, k in zip(names, inner, strict=True)], df[order_col].alias("o"), df[text_col].alias("t"))
    spans = "spans array<struct<a:bigint,b:bigint,i:int,size:int>>"
    base = ", ".join([*(f"{k} {kind}" for k, kind in zip(inner, kinds, strict=True)), f"o {src.schema['o'].dataType.simpleString()}", "t string", "n_sentences long"])

    def find(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            kept = columns_of(batch, [*inner, "o", "t"])
            for s in text_slices(kept[-1]):
                hashes, at, size, counts, sents = [], [], [], [0], []
                for r in range(s.rows):
                    h, i, k, n = spans_of(s.data[s.offs[r] : s.offs[r + 1]], run, min_words, long_words)
                    hashes.append(h.astype(np.int64)), at.append(i), size.append(k), counts.append(len(i)), sents.append(n)
                (a, b), i, k = np.concatenate(hashes, axis=1), np.concatenate(at), np.concatenate(size)
                items = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(i, pa.int32()), pa.array(k, pa.int32())], names=["a", "b", "i", "size"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), items)
                out = [c.slice(s.lo, s.rows) for c in kept]
                yield pa.RecordBatch.from_arrays([*out, pa.array(sents, pa.int64()), pa.array(np.arange(row, row + s.rows)), lists], names=[*inner, "o", "t", "n_sentences", "row", "spans"])
                row += s.rows

    rows = shared.put(map_arrow(src, find, f"{base}, row long, {spans}"), "rows")
    places = rows.select("o", "row", F.inline("spans"))
    seen = places.groupBy("a", "b").agg(F.min(F.struct(F.col("o").isNull().alias("z"), "o", "row", "i")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that its shuffle is gone before the places' one.
    seen = shared.put(seen.select("a", "b", F.col("first.row").alias("row0"), F.col("first.i").alias("i0"), "n"), "seen")
    limit = hub_limit(places)
    hot = seen.where(F.col("n") > limit)
    many = hot.limit(1).count() > 0
    rare = places.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti") if many else places
    again = rare.join(seen.where(F.col("n") <= limit), ["a", "b"]).where("row <> row0 or i <> i0").select("row", "i", "size")
    if many:
        again = again.unionByName(hot_cuts(rows, hot))
    gone = shared.put(again.groupBy("row").agg(F.collect_set(F.struct("i", "size")).alias("cut")), "gone")  # no more than a row has sentences, four times
    joined = rows.drop("spans", "o").join(gone, "row", "left").select(*inner, "t", "n_sentences", "cut")
    schema = ", ".join([*(f"{k} {kind}" for k, kind in zip(inner, kinds, strict=True)), "t string, n_sentences long, n_removed long, words_removed long"])

    def rebuild(batches):
        for batch in batches:
            texts, cuts = columns_of(batch, ["t", "cut"])
            at = np.flatnonzero(cuts.is_valid())
            lost = np.zeros((2, batch.num_rows), np.int64)
            if len(at):
                done = [cut_spans(texts[i].as_py(), cuts[i].as_py()) for i in at.tolist()]
                lost[:, at] = np.array([x[1:] for x in done]).T
                texts = pc.replace_with_mask(texts, cuts.is_valid(), pa.array([x[0] for x in done], texts.type))
            yield pa.RecordBatch.from_arrays([*columns_of(batch, inner), texts, columns_of(batch, ["n_sentences"])[0], pa.array(lost[0]), pa.array(lost[1])], names=[*inner, "t", "n_sentences", "n_removed", "words_removed"])

    done = map_arrow(joined, rebuild, schema)
    own = {**dict(zip(names, inner, strict=True)), text_col: "t"}
    return done.select(*[F.col(own[c]).alias(c) for c in (keep if text_col in keep else [*keep, text_col])], "n_sentences", "n_removed", "words_removed")
