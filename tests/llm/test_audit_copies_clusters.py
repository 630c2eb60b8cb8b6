"""Filter audit, exact dedup and clustering against plain Python, on hard rows and on the driver's small tables."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from . import brute
from atrium.llm import exact_dup, filter_audit, lloyd, words
from atrium.llm.oracle import ORACLE_SQL
from atrium.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
COPY = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def hard_texts():
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(90_000))
    many = [" ".join(f"v{rng.randrange(v)}" for _ in range(n)) for n, v in ((199, 500), (200, 500), (200, 99), (250, 125), (250, 60), (700, 90))]
    base = [None, "", "", " \n\t", "a", "A", "É É\x0bx\x1cy", "x" * 9000 + " " + "x" * 9000, "# no", *many, many[1] + " $", many[3].upper(), "ABC " * 80 + many[2], long, long.upper(), long[:-1] + "~", "z" * 40_000, "z" * 40_001]
    return base + [base[i] for i in (9, 9, 10, 12, 17, 20, 21, 22)] + [many[1]] * 40


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(None if i in (5, 11, 30) else i % 50, t, [None, "", "en", "de"][i % 4], "clash", 1, b"h") for i, t in enumerate(hard_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, recipe string, n int, digest binary").repartition(6).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, q, t) for i in (*range(0, 60, 2), 4) for q, t in [(i % 3 % 2, (i + 1) % 2), (None, i % 2)]] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("limit", [256, 2])
def test_audit(hard, marks, monkeypatch, limit):
    monkeypatch.setattr(filter_audit, "hub_limit", lambda rows: limit)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.filter_audit(hard, marks).collect()}
    rows = [tuple(r) for r in hard.select("doc_id", "text", "lang").collect()]
    assert got == brute.audit(rows, [tuple(r) for r in marks.collect()])
    assert len(got) == 3 * 600


def test_audit_of_one_repeated_row(spark, marks):
    """One text and one id in all rows: the first id stands in all of them, so none is a copy."""
    docs = spark.createDataFrame([(4, "same #", "en")] * 300, "doc_id long, text string, lang string")
    rows = {(r.filter_order, r.step): r for r in filter_audit.filter_audit(docs, marks).collect()}
    assert len(rows) == 600 and rows["EABCD", 1].removed == 0 and rows["EABCD", 2].removed == 300 and rows["DABCE", 1].redundant == 0


def test_words_with_one_hash():
    """Different words whose hashes agree are told apart by their bytes."""
    texts = ["a b c a", "", "ab ba ab", "x" * (words.SLICE_BYTES + 5) + " y " + "x" * (words.SLICE_BYTES + 5), "q r"]
    for s in words.text_slices(pa.array(texts), max_bytes=1 << 24):
        s.split(words.SPACED)
        for h in (s.hashes(), np.zeros(len(s.starts), np.uint64)):
            assert words.verified_distinct(s, h).tolist() == [len(set(t.split())) for t in texts]


@pytest.mark.parametrize(("bits", "broadcast", "limit"), [(128, 10**6, 256), (128, 0, 2), (3, 10**6, 2), (8, 0, 256), (0, 10**6, 256)])
def test_copies(hard, monkeypatch, bits, broadcast, limit):
    """Also with identifiers of so few bits that different chunks share one."""
    monkeypatch.setattr(exact_dup, "hub_limit", lambda rows: limit)
    got = exact_dup.exact_duplicates(hard, bits=bits, max_broadcast=broadcast)
    assert sorted((tuple(r) for r in got.select(*COPY).collect()), key=repr) == brute.exact_copies([tuple(r) for r in hard.select("doc_id", "text").collect()])


def test_chunks_follow_the_text():
    """Chunks join to the text, don't depend on what stands before it, and come back after an insertion."""
    rng = np.random.RandomState(1)
    data = rng.randint(97, 123, 200_000).astype(np.uint8)

    def chunks(before, text):
        both = np.concatenate((before, text))
        ends = exact_dup.chunk_ends(exact_dup.ends_here(both), len(before), len(both))
        return [both[a:b].tobytes() for a, b in zip([len(before), *ends], ends, strict=False)]

    alone = chunks(data[:0], data)
    assert b"".join(alone) == data.tobytes() and max(map(len, alone)) <= exact_dup.MOST and min(map(len, alone[:-1])) >= exact_dup.LEAST
    assert alone == chunks(data[500:777], data)
    moved = chunks(data[:0], np.concatenate((data[:70_000], data[:9], data[70_000:])))
    assert len(set(alone) & set(moved)) > 0.9 * len(alone)


def vectors(rng, n):
    rows = [(i if i % 17 else None, [float(np.float32(rng.gauss(i % 3, 1))) for _ in range(64)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [1.0] * 63 + [None]), (n + 4, [math.nan] + [0.0] * 63), (n + 5, [math.inf] + [0.0] * 63), (n + 6, [-math.inf] * 64), (n + 7, [0.0] * 65)]
    return rows + [(7, rows[7][1]), (7, rows[8][1]), (2**60 + 1, rows[9][1])] + [(n + 20 + i, rows[3][1]) for i in range(200)]


def clusters(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, cluster string").repartition(5)
    return sorted((tuple(r) for r in lloyd.lloyd(df, **kw).select(*CLUSTER).collect()), key=repr)


def test_clusters(spark):
    rows = vectors(random.Random(8), 150)
    assert clusters(spark, rows) == brute.lloyd(rows)


def test_clusters_of_ties_and_few(spark):
    """Equal vectors tie for the lowest centroid, the others stay empty where they are; fewer vectors give fewer centroids."""
    same = [(i, [0.5] * 64) for i in range(40)]
    assert clusters(spark, same) == brute.lloyd(same) and {r[1] for r in clusters(spark, same)} == {0}
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(spark, few) == brute.lloyd(few)
    assert clusters(spark, [(None, [1.0] * 64)]) == [] and clusters(spark, []) == []


def test_clusters_of_large_numbers(spark):
    """Beyond 64 bits vectors are still compared exactly; distances and sums that don't fit a long are null."""
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.choice((0, 5, 8, 9, 300)) for _ in range(4)]) for i in range(60)] + [(60 + i, [1.7e308, -1e308, 0.0, 2.0**30]) for i in range(4)]
    assert clusters(spark, rows, "double", dims=4, k=6) == brute.lloyd(rows, k=6, dims=4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_dedup", "op13_lloyd_clusters"])
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)
