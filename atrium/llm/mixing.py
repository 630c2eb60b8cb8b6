"""Mixing sources to target weights: min-cost flow between membership patterns and source quotas, then seeded documents."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, columns_of, map_arrow
from .words import SPACED, text_slices

DIGITS = 2  # of a place in the order, to a level: 256 buckets

def word_counts(df: DataFrame, keep: list[str], text_col: str, out: str) -> DataFrame:
    """The kept columns and the number of words of each row's whole text (null: 0)."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{out} long"])

    def run(batches):
        for batch in batches:
            got = [s.split(SPACED).counts for s in text_slices(columns_of(batch, ["__text"])[0])]
            yield pa.RecordBatch.from_arrays([*columns_of(batch, keep), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64), pa.int64())], names=[*keep, out])

    return map_arrow(df.select(*[df[c] for c in keep], df[text_col].alias("__text")), run, schema)


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess reshared by weight among the others."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def route(supply: np.ndarray, first: np.ndarray, to: np.ndarray, quota: list[int], passes: int) -> np.ndarray:
    """Words over each link, of the cheapest flow that sends as many words as quotas and passes allow.

    Pattern p has the links first[p] to first[p + 1] - 1, and link e goes to source to[e]. A word's first use costs 1, its
    second 2, and so on, so the cost is convex in how often a pattern is passed. Only passes cost anything, so the
    cheapest path is one of the lowest pass: passes are opened one by one, and each is filled by blocking flows over
    shortest paths. There is a node per pattern and source, whatever the number of documents, in arrays of numbers.
    """
    n_p, n_s = len(supply), len(quota)
    by_source = np.argsort(to, kind="stable")
    nums = lambda kind, x: array(kind, np.ascontiguousarray(x, {"i": np.int32, "q": np.int64}[kind]).tobytes())
    held, begin = nums("i", by_source), nums("q", np.searchsorted(to[by_source], np.arange(n_s + 1)))
    owner, first, to, supply = nums("i", np.repeat(np.arange(n_p), np.diff(first))), nums("q", first), nums("i", to), nums("q", supply)
    flow, room, left = nums("q", np.zeros(len(to))), nums("q", np.zeros(n_p)), nums("q", np.array(quota, np.int64))

    def fill() -> bool:
        """One blocking flow; False if no path is left."""
        depth = nums("i", np.full(n_p + n_s, -1))
        layer = [p for p in range(n_p) if room[p]]
        for p in layer:
            depth[p] = 0
        roots, near = layer, False
        while layer and not near:
            after = []
            for v in layer:
                if v < n_p:
                    beside = (n_p + to[e] for e in range(first[v], first[v + 1]))
                else:  # back over what a pattern has sent
                    beside = (owner[held[i]] for i in range(begin[v - n_p], begin[v - n_p + 1]) if flow[held[i]])
                for w in beside:
                    if depth[w] < 0:
                        depth[w] = depth[v] + 1
                        after.append(w)
                        near |= w >= n_p and left[w - n_p] > 0
            layer = after
        if not near:
            return False
        place = first[:n_p] + begin[:n_s]
        for root in roots:
            path, used = [root], []
            while path and room[root]:
                v = path[-1]
                if v >= n_p and left[v - n_p]:
                    push = min(room[root], left[v - n_p], *(flow[e] for u, e in zip(path, used, strict=False) if u >= n_p))
                    for u, e in zip(path, used, strict=False):
                        flow[e] += push if u < n_p else -push
                    room[root] -= push
                    left[v - n_p] -= push
                    path, used = [root], []
                    continue
                at, want = place[v], depth[v] + 1
                if v < n_p:
                    end = first[v + 1]
                    while at < end and depth[n_p + to[at]] != want:
                        at += 1
                    step = (n_p + to[at], at) if at < end else None
                else:
                    end = begin[v - n_p + 1]
                    while at < end and not (flow[held[at]] and depth[owner[held[at]]] == want):
                        at += 1
                    step = (owner[held[at]], held[at]) if at < end else None
                place[v] = at
                if step:
                    path.append(step[0])
                    used.append(step[1])
                else:
                    path.pop()
                    if path:
                        used.pop()
                        place[path[-1]] += 1
        return True

    for _ in range(passes):
        for p in range(n_p):
            room[p] += supply[p]
        while fill():
            pass
    return np.frombuffer(flow, np.int64)


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], passes: int) -> dict[tuple[int, int], int]:
    """route() by pattern and source."""
    links = [(p, s) for p, own in enumerate(members) for s in own]
    sent = route(np.array(supply, np.int64), np.cumsum([0, *map(len, members)]), np.array([s for _, s in links], np.int64), quota, passes)
    return {link: int(f) for link, f in zip(links, sent, strict=True) if f}


def edges_of(shared: Shared, sized: DataFrame, quotas: DataFrame, few: bool, small: int) -> DataFrame:
    """(pat, edge, need): of each pattern with a rest, the beginning of the places at which the rest ends, and the words to take among those that begin so.

    Level by level the words of 256 buckets are summed, and the one that the rest ends in is parted further, until it
    holds at most small rows. So no task ranks more than 256 buckets of a pattern, however many rows it has.
    """
    near = lambda df: F.broadcast(df) if few else df
    live = quotas.where("rest > 0").select("pat", F.lit("").alias("edge"), F.col("rest").alias("need"))
    done, level = [], 0
    while True:
        bucket = F.substring("at", 1, DIGITS * (level + 1))
        rows = sized.select("pat", "at", "size").join(near(live), "pat").where(F.col("at").startswith(F.col("edge")))
        sums = rows.groupBy("pat", bucket.alias("b"), "need").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pat").orderBy("b")))
        best = sums.where("upto >= need").groupBy("pat").agg(F.min(F.struct("b", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "m")).alias("x"))
        found = shared.put(best.select("pat", F.col("x.b").alias("edge"), "x.need", "x.m"), f"edges-{level}")
        level += 1
        full = DIGITS * level >= 32
        done.append(found.where(F.lit(full) | (F.col("m") <= small)).select("pat", "edge", "need"))
        live = found.where(F.col("m") > small).select("pat", "edge", "need")
        if full or live.limit(1).count() == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def mix_sources(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, seed: str = "mix-1", few_patterns: int = 20_000, max_broadcast_rows: int = 200_000, edge_rows: int = 256) -> DataFrame:
    """The kept columns, size, source_size, target, copies and taken (size * copies) of every row.

    source_col holds one source or an array of them; a document of several may serve any, and shows the size and target
    of its first. Rows of one pattern are taken in the order of md5(seed, id), of a null id md5(seed, text): whole passes
    first, then the first documents up to the rest. Every pattern keeps all its sources, however many patterns there
    are; the driver holds a few numbers for each source, pattern and member of a pattern, and nothing of documents.

    A null text has size 0 and a null (or empty) source is a source of its own, last; very long texts count whole; rows
    that tie in the order, as repeated rows do, are taken or left together; kept columns named like the result's own are
    replaced by those; empty tables give an empty result. The bounds only choose between broadcast and shuffle.
    """
    spark, shared = df.sparkSession, Shared(df.sparkSession)
    keep = [c for c in keep if c not in ("size", "source_size", "target", "copies", "taken")]
    inner = [f"k{i}" for i in range(len(keep))]
    many = df.schema[source_col].dataType.typeName() == "array"
    own = lambda x: F.coalesce(F.concat(F.lit("s"), x.cast("string")), F.lit("~"))  # noqa: E731  "~" is after every "s...": null comes last
    sorted_set = F.array_sort(F.array_distinct(F.transform(df[source_col], own))) if many else F.array(own(df[source_col]))
    pattern = F.when(F.coalesce(F.size(sorted_set), F.lit(0)) > 0, sorted_set).otherwise(F.array(F.lit("~")))
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(df[id_col].cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(df[text_col], F.lit("")))))))
    src = df.select(*[df[c].alias(k) for c, k in zip(keep, inner, strict=True)], pattern.alias("pat"), place.alias("at"), df[text_col].alias("t"))
    sized = shared.put(word_counts(src, [*inner, "pat", "at"], "t", "size"), "sized")
    patterns = shared.put(sized.groupBy("pat").agg(F.sum("size").alias("n")), "patterns")
    of = patterns.select(F.explode("pat").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    of.sort(key=lambda r: r["s"].encode())
    index, sizes = {r["s"]: i for i, r in enumerate(of)}, [r["n"] for r in of]
    numbers = spark.createDataFrame(list(index.items()), "s string, i int")
    numbered = patterns.select("pat", "n", F.posexplode("pat").alias("p", "s")).join(F.broadcast(numbers) if len(index) <= few_patterns else numbers, "s")
    got = numbered.groupBy("pat", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "i"))), lambda x: x["i"]).alias("own")).select("own", "n").orderBy("own").toArrow()
    supply, lists = got.column("n").to_numpy(), got.column("own").combine_chunks()
    total = int(supply.sum())
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total * share, max_repeat)
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(False)))).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    to = lists.flatten().to_numpy(False) if len(lists) else np.zeros(0, np.int32)
    sent = route(supply, first, to, [round(g) for g in goal], max_repeat)
    routed = np.add.reduceat(sent, first[:-1]) if len(sent) else np.zeros(0, np.int64)
    full, rest = np.divmod(routed, np.maximum(supply, 1))
    head = to[first[:-1]]
    plan = pa.table({"own": lists, "full": pa.array(full), "rest": pa.array(rest), "source_size": pa.array(np.array(sizes, np.int64)[head]), "target": pa.array(np.array(goal, float)[head])})
    few = len(supply) <= few_patterns
    quotas = spark.createDataFrame(plan)
    quotas = shared.put(quotas.join(numbered.groupBy("pat").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "i"))), lambda x: x["i"]).alias("own")), "own").select("pat", "full", "rest", "source_size", "target"), "quotas")
    edges = shared.put(edges_of(shared, sized, quotas, few, edge_rows), "edges")
    near = lambda df: F.broadcast(df) if few else df
    at_edge = sized.select("pat", "at", "size").join(near(edges), "pat").where(F.col("at").startswith(F.col("edge"))).groupBy("pat", "at", "need").agg(F.sum("size").alias("n"))
    at_edge = at_edge.withColumn("upto", F.sum("n").over(Window.partitionBy("pat").orderBy("at")))
    picked = shared.put(at_edge.where(F.col("upto") - F.col("n") / 2 <= F.col("need")).select("pat", "at", F.lit(1).alias("taken_in")), "picked")
    picked = F.broadcast(picked) if picked.count() <= max_broadcast_rows else picked  # else rows are shuffled with what is kept of them
    done = sized.join(near(quotas), "pat").join(near(edges.drop("need")), "pat", "left").join(picked, ["pat", "at"], "left")
    before = F.col("at").substr(F.lit(1), F.length("edge")) < F.col("edge")
    copies = (F.col("full") + F.when(before | F.col("taken_in").isNotNull(), 1).otherwise(0)).cast("long")
    return done.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
