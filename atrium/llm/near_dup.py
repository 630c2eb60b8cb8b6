"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on whole shingle sets.

A signature has CHUNKS * WIDTH symbols of 16 bits, each the low bits of one minimum hash. Two signatures that differ in
at most 2 * CHUNKS - 1 symbols have, by pigeonhole, a chunk that differs in at most one; each chunk is indexed once for
each symbol left out, so such a pair always meets under some key. At similarity 0.8 the chance that two signatures
differ in more symbols is 3.3e-6, and that they meet under no key below 1e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, columns_of, components, free_name, hub_limit, map_arrow, spread_join
from .words import SPACED, U, Slice, distinct_by_row, mix, text_slices, windows

CHUNKS, WIDTH = 12, 4
SYMBOLS = CHUNKS * WIDTH
MAX_DISTANCE = 2 * CHUNKS - 1
_R = np.random.RandomState(77)
_XOR = _R.randint(0, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(U)
_MUL = _R.randint(1, 2**62, SYMBOLS, dtype=np.int64).astype(U) * U(2) + U(1)
BLOCK = 512  # rows of a bucket in one of its blocks; a task holds two blocks
CACHE_BYTES = 16 << 20


def shingle_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (54-bit hashes) of each row, lower-cased; a shorter row is one shingle. (values, bounds)"""
    s.split(SPACED)
    h, row, counts = s.hashes(lower=True), s.row_of_word(), s.counts
    parts, rows = [], []
    for size in range(1, k + 1):
        g, at = windows(h, s.bounds, size)
        if size < k:  # only rows of exactly so many words
            own = counts[row[at]] == size
            g, at = mix(g[own] + U(size)), at[own]
        parts.append(g), rows.append(row[at])
    return distinct_by_row(np.concatenate(rows), np.concatenate(parts), s.rows)


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit id of each row's set, the same for equal sets; 0 for the empty set."""
    n = np.diff(bounds)
    c = np.concatenate((np.zeros(1, U), np.cumsum(mix(values + U(11)), dtype=U)))
    d = np.concatenate((np.zeros(1, U), np.cumsum(mix(values ^ U(0x5DEECE66D)), dtype=U)))
    got = mix((c[bounds[1:]] - c[bounds[:-1]]) ^ mix(d[bounds[1:]] - d[bounds[:-1]] + n.astype(U))) >> U(1)
    return np.where(n > 0, np.maximum(got, U(1)), U(0)).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) of 16 bits; rows with an empty set are zero."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    if len(full):
        v = mix(values)
        for j in range(SYMBOLS):
            out[full, j] = (np.minimum.reduceat((v ^ _XOR[j]) * _MUL[j], bounds[full]) & U(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys: every chunk with each of its symbols left out."""
    c = sig.reshape(len(sig), CHUNKS, WIDTH).astype(U)
    keys = np.zeros((len(sig), CHUNKS, WIDTH), U)
    for out in range(WIDTH):
        for j in (j for j in range(WIDTH) if j != out):
            keys[:, :, out] = (keys[:, :, out] << U(16)) | c[:, :, j]
    tag = (np.arange(CHUNKS * WIDTH, dtype=U) << U(48)).reshape(1, CHUNKS, WIDTH)
    return (keys | tag).reshape(len(sig), -1).astype(np.int64)


def sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def sign(df: DataFrame, k: int) -> DataFrame:
    """(id, n, sid, sig) of (id, t)."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = columns_of(batch, ["id", "t"])
            n, sid, sig = [], [], []
            for s in text_slices(texts):
                values, bounds = shingle_sets(s, k)
                n.append(np.diff(bounds)), sid.append(set_ids(values, bounds))
                sig += [x.tobytes() for x in signatures(values, bounds)]
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, join(n), join(sid), pa.array(sig, pa.binary())], names=["id", "n", "sid", "sig"])

    return map_arrow(df, run, f"id {kind}, n long, sid long, sig binary")


def index(reps: DataFrame) -> DataFrame:
    """(key, sid): what each signature is found under."""

    def run(batches):
        for batch in batches:
            sids, sigs = columns_of(batch, ["sid", "sig"])
            for lo in range(0, len(sids), 4096):
                part = sigs.slice(lo, 4096)
                keys = chunk_keys(sig_matrix(part))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(sids.slice(lo, 4096).to_numpy(), keys.shape[1]))], names=["key", "sid"])

    return map_arrow(reps.select("sid", "sig"), run, "key long, sid long")


def near(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those (a, b, sa, sb) whose signatures differ in at most MAX_DISTANCE symbols and whose sizes allow it."""

    def run(batches):
        for batch in batches:
            a, b, sa, sb = columns_of(batch, ["a", "b", "sa", "sb"])
            ok = pa.array(((sig_matrix(sa) != sig_matrix(sb)).sum(1) <= MAX_DISTANCE) if len(a) else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    sized = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return map_arrow(sized.select("a", "b", "sa", "sb"), run, "a long, b long")


def by_bucket(batches, closed):
    """Runs closed over whole buckets of rows that come sorted by bucket."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        b = held.column("bucket").to_numpy()
        if not len(b) or b[0] == b[-1]:
            continue
        cut = int(np.flatnonzero(b != b[-1])[-1]) + 1
        yield from closed(held.slice(0, cut).combine_chunks())
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from closed(held.combine_chunks())


class Bucket:
    """Rows of one bucket, at most 2 * BLOCK: which of them are near and of different components.

    A pair counts only in the first bucket that it meets in: under its first chunk with at most one difference, and the
    key that leaves out the differing symbol (or the first).
    """

    def __init__(self, t: pa.Table, percent: int):
        self.slot, self.half, self.sid, self.comp, self.n = (t.column(c).to_numpy() for c in ("slot", "half", "sid", "comp", "n"))
        self.sig = sig_matrix(t.column("sig").combine_chunks())
        self.percent = percent

    def sides(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What to compare with what: of two halves, one with the other, else all rows with all."""
        second = self.half[rows] == 1
        return (rows[~second], rows[second]) if second.any() and not second.all() else (rows, rows)

    def near(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """A matrix for rows against cols; both are indexes."""
        shape = (len(rows), len(cols))
        total, first, own = np.zeros(shape, np.uint8), np.full(shape, 99, np.uint8), np.zeros(shape, np.uint8)
        slot = self.slot[rows[0]]
        for c in range(CHUNKS):
            e = np.zeros(shape, np.uint8)
            for j in range(c * WIDTH, c * WIDTH + WIDTH):
                e += self.sig[rows, j, None] != self.sig[None, cols, j]
            total += e
            first[(e <= 1) & (first == 99)] = c
            if c == slot // WIDTH:
                own = e
        small, big = np.minimum(self.n[rows, None], self.n[None, cols]), np.maximum(self.n[rows, None], self.n[None, cols])
        ok = (total <= MAX_DISTANCE) & (first == slot // WIDTH) & ((own == 1) | (slot % WIDTH == 0)) & (100 * small >= self.percent * big)
        return ok & (self.comp[rows, None] != self.comp[None, cols])


def cuts_of(t: pa.Table) -> np.ndarray:
    b = t.column("bucket").to_numpy()
    return np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))


def needed(rows: DataFrame, percent: int) -> DataFrame:
    """Those rows (bucket, slot, half, sid, comp, n, sig) that have a near row of another component in their bucket."""

    def closed(t):
        cuts = cuts_of(t)
        whole = Bucket(t, percent)
        keep = np.zeros(t.num_rows, bool)
        lens = np.diff(cuts)
        two = np.flatnonzero(lens == 2)  # most buckets, at once, by distance and component alone
        x, y = cuts[two], cuts[two] + 1
        ok = ((whole.sig[x] != whole.sig[y]).sum(1) <= MAX_DISTANCE) & (whole.comp[x] != whole.comp[y])
        keep[x[ok]] = keep[y[ok]] = True
        for k in np.flatnonzero(lens > 2):
            rows, cols = whole.sides(np.arange(cuts[k], cuts[k + 1]))
            for lo in range(0, len(rows), 256):
                ok = whole.near(rows[lo : lo + 256], cols)
                keep[cols] |= ok.any(0)
                keep[rows[lo : lo + 256]] |= ok.any(1)
        yield from t.filter(pa.array(keep)).to_batches()

    return map_arrow(rows, lambda it: by_bucket(it, closed), rows.schema)


def crosswise(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows that are near and of different components and whose sets, by 32-bit hashes, are similar enough.

    rows: as of needed(), with the set of each row. Hashes that coincide only add to what two sets share, so no pair is
    lost here; confirm() decides.
    """

    def closed(t):
        cuts = cuts_of(t)
        whole = Bucket(t, percent)
        sets = t.column("set").combine_chunks()
        for k in range(len(cuts) - 1):
            if cuts[k + 1] - cuts[k] < 2:
                continue
            mine = dict(enumerate((np.frombuffer(x, np.uint32) for x in sets.slice(cuts[k], cuts[k + 1] - cuts[k]).to_pylist()), cuts[k]))
            rows, cols = whole.sides(np.arange(cuts[k], cuts[k + 1]))
            for lo in range(0, len(rows), 256):
                ok = whole.near(rows[lo : lo + 256], cols)
                if rows is cols:
                    ok &= whole.sid[rows[lo : lo + 256], None] < whole.sid[None, cols]
                found = []
                for i in np.flatnonzero(ok.any(1)):
                    row = rows[lo + i]
                    own = mine[row]
                    to = cols[ok[i]]
                    for part in np.array_split(to, len(to) // 256 + 1):
                        lens = np.array([len(mine[j]) for j in part])
                        flat = np.concatenate([mine[j] for j in part])
                        at = np.searchsorted(own, flat)
                        at[at == len(own)] = 0
                        hit = np.concatenate(([0], np.cumsum(own[at] == flat)))
                        stop = np.cumsum(lens)
                        both = hit[stop] - hit[stop - lens]
                        good = 100 * both >= percent * (whole.n[row] + whole.n[part] - both)
                        found += [tuple(sorted((whole.sid[row], whole.sid[j]))) for j in part[good]]
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(rows, lambda it: by_bucket(it, closed), "a long, b long")


def packed_sets(texts: DataFrame, k: int) -> DataFrame:
    """(sid, set): the sorted 32-bit hashes of each set's shingles."""

    def run(batches):
        for batch in batches:
            sids, col = columns_of(batch, ["sid", "t"])
            out = []
            for s in text_slices(col):
                values, bounds = shingle_sets(s, k)
                small = (values >> U(22)).astype(np.uint32)  # sorted within each row as the values are
                out += [small[bounds[r] : bounds[r + 1]].tobytes() for r in range(s.rows)]
            yield pa.RecordBatch.from_arrays([sids, pa.array(out, pa.binary())], names=["sid", "set"])

    return map_arrow(texts, run, "sid long, set binary")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) with 100 * |A and B| >= percent * |A or B| on whole shingle sets. texts: (sid, t), a row per set."""

    def run(batches):
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                a, b, ta, tb = columns_of(part, ["a", "b", "ta", "tb"])
                sets = []
                for ids, col in ((a.to_pylist(), ta), (b.to_pylist(), tb)):
                    new = [i for i, x in enumerate(ids) if x not in cache]
                    new = list({ids[i]: i for i in new}.values())
                    at = 0
                    for s in text_slices(col.take(pa.array(new, pa.int64()))) if new else ():
                        values, bounds = shingle_sets(s, k)
                        for r in range(s.rows):
                            cache[ids[new[at]]] = values[bounds[r] : bounds[r + 1]]
                            at += 1
                    sets.append([cache[x] for x in ids])
                ok = []
                for x, y in zip(*sets, strict=True):
                    small, big = (x, y) if len(x) <= len(y) else (y, x)
                    if 100 * len(small) < percent * len(big):
                        ok.append(False)
                        continue
                    at = np.searchsorted(big, small)
                    at[at == len(big)] = 0
                    both = int((big[at] == small).sum())
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                if sum(x.nbytes for x in cache.values()) > CACHE_BYTES:
                    cache.clear()
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = spread_join(pairs, texts.select(F.col("sid").alias("a"), F.col("t").alias("ta")), "a", hub_limit(pairs))
    both = left.join(texts.select(F.col("sid").alias("b"), F.col("t").alias("tb")), "b")
    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the least id linked with it, over any number of links.

    Equal sets are one node, so copies are never paired. Every bucket of the index is first tied to its least member,
    a pair per member; after confirming those, only buckets that still hold several components are compared crosswise,
    large ones in blocks and without the pairs inside their largest component. Nothing is capped: all near pairs of different components are confirmed on whole sets.
    Without words, null included, a row is alone; a very long text gives its whole set; repeated rows and ids each give
    a row; of a group's rows that tie for the least id all are kept; a null id is least of all; an empty table gives an
    empty result; columns besides the id and the text don't matter, whatever their names.
    """
    shared = Shared(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("t"))
    rows = shared.put(sign(src, k), "rows")
    groups = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct("id", "n", "sig")).alias("x"))
    reps = shared.put(groups.select("sid", "x.*"), "reps")
    keys = shared.put(index(reps), "keys")
    shares = keys.groupBy("key").agg(F.min("sid").alias("lead"), F.count("*").alias("m")).where("m > 1")
    multi = shared.put(keys.join(shares, "key").select("key", "sid", "lead", "m"), "multi")
    shared.drop("keys")
    sig = lambda c: reps.select(F.col("sid").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    stars = multi.where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    stars = shared.put(near(stars.join(sig("a"), "a").join(sig("b"), "b"), percent), "stars")
    links = shared.put(confirm(stars, shared.put(texts_of(src, reps, stars, k), "texts"), k, percent), "links")
    comp = components(shared, links, "cc")
    named = multi.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "m", F.coalesce("comp", "sid").alias("comp"))
    named = shared.put(named, "named")
    for done in ("multi", "texts", "stars"):
        shared.drop(done)
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = shared.put(named.join(mixed, "key", "left_semi"), "rest")
    shared.drop("named")
    # The rows of a bucket's largest component needn't meet each other, only the others of the bucket, which meet all.
    # A bucket of more than BLOCK rows is dealt in p blocks of others and q of the largest component: p * (p + 1) / 2 + p * q tasks.
    top = rest.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"))
    ranked = spread_join(rest, top.select("key", F.col("top.c").alias("c"), F.col("top.comp").alias("main")), "key", hub_limit(rest))
    whole, main = F.col("m") <= BLOCK, F.col("comp") == F.col("main")
    p, q = (F.ceil(x / BLOCK).cast("int") for x in (F.col("m") - F.col("c"), F.col("c")))
    own = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    dealt = ranked.withColumn("i", F.when(whole, 0).when(main, p + own(q)).otherwise(own(p)))
    last = F.when(whole, 0).when(main, p - 1).otherwise(p + q - 1)
    spread = dealt.select("sid", "comp", "key", "i", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    slot = F.call_function("shiftright", F.col("key"), F.lit(48)).cast("int")
    spread = spread.select("sid", "comp", slot.alias("slot"), F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("half"))
    names = ["bucket", "slot", "half", "sid", "comp", "n", "sig"]
    laid = spread.join(reps.select("sid", "n", "sig"), "sid").repartition("bucket").sortWithinPartitions("bucket").select(*names)
    want = shared.put(needed(laid, percent), "needed")
    sets = packed_sets(texts_of(src, reps, want.select(F.col("sid").alias("a"), F.col("sid").alias("b")), k), k)
    full = want.join(sets, "sid").repartition("bucket").sortWithinPartitions("bucket").select(*names, "set")
    more = shared.put(crosswise(full, percent).distinct(), "more")
    for done in ("needed", "rest"):
        shared.drop(done)
    extra = shared.put(confirm(more, shared.put(texts_of(src, reps, more, k), "texts2"), k, percent), "extra")
    comp = shared.put(components(shared, links.unionAll(extra), "all"), "comp")
    shared.drop("texts2")
    named = reps.select("sid", "id").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    final = named.join(least, "comp").select("sid", "component")
    out = rows.select("id", "n", "sid").join(final, "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def texts_of(src: DataFrame, reps: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(sid, t) of the sets in pairs, one text each. Ids may repeat with other texts, so the set id is taken again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps.select("sid", "id"), "sid")

    def run(batches):
        for batch in batches:
            sids, texts = columns_of(batch, ["sid", "t"])
            got = [set_ids(*shingle_sets(s, k)) for s in text_slices(texts)]
            ok = pa.array(np.concatenate(got) == sids.to_numpy() if got else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([sids.filter(ok), texts.filter(ok)], names=["sid", "t"])

    found = src.where(F.col("t").isNotNull()).join(wanted, src["id"].eqNullSafe(wanted["id"])).select("sid", "t")
    return map_arrow(found, run, "sid long, t string").groupBy("sid").agg(F.min("t").alias("t"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    """One row of each group, with all columns: the least id's. Of rows that repeat that id in one group, the least text stays, once.

    Rows without words, null texts included, all stay, repeats too; a null id is least of all; very long texts count
    whole; an empty table gives an empty result; columns may have any names.
    """
    mark = F.struct(df[id_col].alias("i"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("r"))
    shared, key = Shared(df.sparkSession), free_name(df, "__key")
    tagged = shared.put(df.withColumn(key, mark), "tagged")
    kept = near_duplicates(tagged.select(key, text_col), key, text_col, **args).where("kept").select(key)
    return tagged.join(kept, key, "left_semi").drop(key)
