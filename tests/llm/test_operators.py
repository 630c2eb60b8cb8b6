"""Operators against plain Python on tricky tables, and on a small table of the driver's."""

import collections
import glob
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from atrium.llm import common, html_text, licences, mixing, near_dup, ppm, quality_model, quality_rules, span_dup, url_rules
from atrium.llm.decontaminate import clean_documents, decontaminate
from atrium.llm.html_text import extract, extract_text
from atrium.llm.words import ALNUM, SPACED, text_slices

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, t int, __x int"


def text(rng, n, vocab=60):
    words = [f"w{rng.randrange(vocab)}" for _ in range(n)]
    return " ".join(w + (". " if rng.random() < 0.15 else "").rstrip() for w in words)


@pytest.fixture(scope="module")
def tricky(spark):
    """Nulls, empty and blank texts, copies and near copies, ties, one very long text, odd white space, clashing columns."""
    rng = random.Random(5)
    base = [text(rng, n) for n in (3, 4, 5, 60, 120, 400)]
    long = text(rng, 60_000, 5000)
    near = base[5].replace("w1 ", "x1 ", 2)
    texts = [None, "", "  \n\t ", "a", "MIT License", "the Apache License mit LICENSE gpl General Public-License", *base, *base[3:], near, near + " tail", long, base[4].upper(), "É É É é\x0bx\x1cy", "no stops here", "One two three four five six. Seven eight nine.\nTen! Eleven?\n\nOne two three four five six. Seven eight nine.\nTen! z", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    texts += [f"intro {i}. Shared passage starts here now. It goes on for a while. And it ends here. Outro {i * 7}." for i in range(30)]
    rows = [(i, t, [None, "en", "de"][i % 3], ["a", "b", None, "a", "a"][i % 5], None, 0.5, "z", i, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def docs(tricky):
    return sorted((r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect())


def by_id(df, key, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(key, *cols).collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w) if any(isinstance(x, float) for x in w) else got[k] == w, k


def test_words_across_slices(docs):
    import pyarrow as pa

    col = pa.array([t for _, t in docs])
    for is_word, pattern, lower in ((SPACED, brute.SPACED, False), (ALNUM, brute.ALNUM, True)):
        counts, hashes = [], {}
        for s in text_slices(col, 300, 4):
            h = s.split(is_word).hashes(lower)
            counts += s.counts.tolist()
            for i, (a, b) in enumerate(zip(s.starts, s.ends, strict=True)):
                w = bytes(s.data[a:b]).decode()
                assert hashes.setdefault(brute.low(w) if lower else w, h[i]) == h[i]
        assert counts == [len(pattern.findall(brute.low(t) if lower else t or "")) for _, t in docs]
        assert len(set(hashes.values())) == len(hashes)


def test_licences(tricky, docs):
    got = licences.licence_scan(tricky)
    same(by_id(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), {i: brute.licences(t) for i, t in docs})
    part = next(r for r in got.collect() if r.n_words == 13 and r.spans)
    assert [(s.label, s.start, s.end) for s in part.spans] == [("mit", 0, 13)]
    assert 0 < part.score < 1
    full = got.sparkSession.createDataFrame([(1, "x " + licences.TEMPLATES[0][1] + " y"), (2, "this work is licensed under the GNU general public license, version 3.")], "doc_id long, text string")
    assert by_id(licences.licence_scan(full), "doc_id", "labels", "score") == {1: ("mit", 1.0), 2: ("gpl", 1.0)}


def test_licence_spans(tricky, docs):
    """Spans, labels and scores are those of comparing all pieces of all templates, in whole, cut, mixed and ordinary texts."""
    rng = random.Random(12)
    parts = [t.split() for _, t in licences.TEMPLATES]
    made = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(parts)
            a = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            p = p[a : a + rng.randrange(1, 40)] if rng.random() < 0.5 else list(p)
            words += [w if rng.random() < 0.97 else "other" for w in p] + ["x"] * rng.randrange(9)
        made.append((10_000 + i, " ".join(words)))
    rows = [*docs, *made]
    got = {r.doc_id: r for r in licences.licence_scan(tricky.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = brute.licence_spans(t, licences.TEMPLATES)
        assert [tuple(s)[:3] for s in sorted(got[i].spans)] == [w[:3] for w in want], i
        assert [s.covered for s in sorted(got[i].spans)] == pytest.approx([w[3] for w in want]), i
        base = set(got[i].base_labels.split(",")) - {""}
        assert got[i].labels == ",".join(sorted(base | {w[0] for w in want if w[3] >= 0.6})), i
        assert got[i].score == pytest.approx(1.0 if base else max((w[3] for w in want), default=0.0)), i


def test_licences_by_clause(spark):
    """Bodies without their openings, and clauses that only one of two licences has, are told apart."""
    t = collections.defaultdict(list)
    for label, x in licences.TEMPLATES:
        t[label].append(x)
    bsd2 = "Copyright 2020 A. " + ". ".join(t["bsd"])
    texts = [bsd2, bsd2 + ". " + t["bsd-3-clause"][0], bsd2 + ". " + t["bsd-4-clause"][0] + ". " + t["bsd-3-clause"][0], t["isc"][1], "THE" + t["mit"][3].partition("THE")[2], "The software is provided with care, and in no event shall the authors sing."]
    got = by_id(licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "labels")
    assert got == {0: ("bsd",), 1: ("bsd,bsd-3-clause",), 2: ("bsd,bsd-3-clause,bsd-4-clause",), 3: ("isc",), 4: ("mit",), 5: ("",)}


def test_short_licence_templates(spark):
    """Templates of fewer than min_match words count where they stand whole, alone or in longer matches, and not in part."""
    texts = ["x y.\nAll rights reserved. z", "Copyright 2024 Name. All rights reserved", "Copyright. All rights reserved", "all rights", "rights reserved", "All rights reserved. All Rights Reserved", "all", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licence_scan(df).collect()}
    assert [(got[i].labels, got[i].score) for i in range(8)] == [("reserved", 1.0)] * 3 + [("", 0.0)] * 2 + [("reserved", 1.0)] + [("", 0.0)] * 2
    assert [(s.start, s.end) for s in got[0].spans] == [(2, 5)]
    assert [(s.start, s.end) for s in got[5].spans] == [(0, 3), (3, 6)]
    own = [("one", "solo"), ("two", "solo b"), ("long", "a solo b c d e"), ("none", "")]
    got = by_id(licences.licence_scan(spark.createDataFrame([(1, "a solo b c d e"), (2, "z solo z"), (3, "b c d")], "doc_id long, text string"), templates=own), "doc_id", "labels")
    assert got == {1: ("long,one,two",), 2: ("one",), 3: ("",)}


def test_automaton_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        auto = licences.Automaton(seqs)
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        read = [rng.randrange(4) for _ in range(40)]
        state = length = 0
        for i in range(len(read)):
            state, length = auto.step(state, length, read[i])
            assert length == max((k for k in range(1, i + 2) if tuple(read[i + 1 - k : i + 1]) in subs), default=0)


def test_targets_and_flow():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 9))]
        assert mixing.targets(sizes, [i % 3 + 1 for i in range(len(sizes))], sum(sizes), 3) == pytest.approx(brute.mix_targets(sizes))
    # Overlap: the shared pattern serves the source that has nothing of its own, and repetition is spread.
    assert mixing.min_cost_flow([100, 50], [[0], [0, 1]], [100, 50], 3) == {(0, 0): 100, (1, 1): 50}
    assert mixing.min_cost_flow([10, 10], [[0], [0]], [30], 3) in ({(0, 0): 20, (1, 0): 10}, {(0, 0): 10, (1, 0): 20})
    assert mixing.min_cost_flow([10], [[0]], [99], 3) == {(0, 0): 30}


def test_mix(tricky, docs):
    got = mixing.mix_sources(tricky, ["doc_id", "source"]).cache()
    again = mixing.mix_sources(tricky.repartition(2), ["doc_id", "source"])
    assert by_id(got, "doc_id", "taken") == by_id(again, "doc_id", "taken")
    shuffled = mixing.mix_sources(tricky, ["doc_id", "source"], max_broadcast_rows=0)
    assert by_id(got, "doc_id", "taken") == by_id(shuffled, "doc_id", "taken")
    size = {i: len(brute.SPACED.findall(t or "")) for i, t in docs}
    rows = got.collect()
    assert {r.doc_id: r["size"] for r in rows} == size
    order = ["a", "b", None]
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in order]
    for s, n, goal in zip(order, sizes, brute.mix_targets(sizes), strict=True):
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {n}
        assert {round(r.target, 6) for r in mine} == {round(goal, 6)}
        assert abs(sum(r.taken for r in mine) - goal) <= max(r["size"] for r in mine) / 2 + 1
        assert all(r.taken <= 3 * r["size"] for r in mine)


def test_mix_of_members(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b"], None, [], ["a", None]] * 20)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), ["doc_id"])
    assert got.count() == 120
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(1200, abs=30)


def test_mix_of_members_is_cheapest(spark):
    """With texts of one word, patterns are taken as the best of all routings takes them; a bound on broadcasts and small edges change nothing."""
    rng = random.Random(2)
    for _ in range(3):
        patterns = rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 4)
        supply = {p: rng.randrange(1, 4) for p in patterns}
        rows = [(f"{p}{i}", "w", list(p)) for p, n in supply.items() for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id string, text string, source array<string>")
        got = mixing.mix_sources(df, ["doc_id", "source"]).collect()
        names = sorted({s for p in patterns for s in p})
        quota = [round(g) for g in brute.mix_targets([sum(n for p, n in supply.items() if s in p) for s in names], total=len(rows))]
        links = [(p, s) for p in patterns for s in p]
        best = None
        for f in itertools.product(*(range(min(3 * supply[p], quota[names.index(s)]) + 1) for p, s in links)):
            sent = {p: sum(x for x, (q, _) in zip(f, links, strict=True) if q == p) for p in patterns}
            if all(sent[p] <= 3 * supply[p] for p in patterns) and all(sum(x for x, (_, z) in zip(f, links, strict=True) if z == s) <= q for s, q in zip(names, quota, strict=True)):
                cost = -sum(f), sum(k // supply[p] + 1 for p in patterns for k in range(sent[p]))
                best = min(best or cost, cost)
        sent = {p: sum(r.taken for r in got if tuple(r.source) == p) for p in patterns}
        assert (-sum(sent.values()), sum(k // supply[p] + 1 for p in patterns for k in range(sent[p]))) == best
    again = mixing.mix_sources(df, ["doc_id"], few_patterns=0, max_broadcast_rows=0, edge_rows=1)
    assert by_id(again, "doc_id", "taken") == {r.doc_id: (r.taken,) for r in got}


def test_mix_of_hard_rows(spark):
    """Null ids are parted by their texts, repeated rows go together, and kept columns may have the result's names."""
    rows = [(None, f"w{i} " * 5, "a", 7) for i in range(40)] + [(1, "x y z", "b", 7)] * 3 + [(2, None, None, None), (3, "q " * 30_000, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df, df.columns)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert len({r.copies for r in rows if r.doc_id == 1}) == 1 and len(rows) == 45
    few = spark.createDataFrame([r for r in [(None, f"w{i} " * 5, s) for i in range(40) for s in "ab"]], "doc_id long, text string, source string")
    got = mixing.mix_sources(few, ["source"]).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 5 for r in got)


def test_rules(tricky, docs):
    got = quality_rules.quality_rules(tricky)
    same(by_id(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), {i: brute.rules(t) for i, t in docs})
    assert got.where("base_failed and kept").count() == 0


def test_sketches_merge(spark):
    rng = random.Random(2)
    v = [int(rng.paretovariate(0.7)) for _ in range(4000)]
    df = spark.createDataFrame([(x % 3, "m", x, 1) for x in v], "k int, name string, v long, n int")
    q = {"lo": 0.25, "mid": 0.5, "hi": 0.9}
    whole = quality_rules.quantiles(quality_rules.sketches(df, ["k"]), ["k"], q)
    parts = quality_rules.sketches(df.where("v % 2 = 0"), ["k"]).unionAll(quality_rules.sketches(df.where("v % 2 = 1"), ["k"]))
    merged = quality_rules.quantiles(parts.groupBy("k", "name", "bucket").agg(F.sum("n").alias("n")), ["k"], q)
    assert by_id(whole, "k", *q) == by_id(merged, "k", *q)
    for k, got in by_id(whole, "k", *q).items():
        mine = sorted(x for x in v if x % 3 == k)
        for x, share in zip(got, q.values(), strict=True):
            true = mine[int(np.ceil(share * len(mine))) - 1]
            assert true <= x <= true * (1 + 1 / 32) + 1


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://x.Example.NET/en/1?q#f", "http://example.net/en", "https://example.com/de/x", "ftp://sub.example.com/fr/de/", "http://notexample.com/de/", "http://org/fr/", "http://w.org/fr/a://b", "http://w.org?x=/fr/", "http://net#/", "a://b\n.net/x\ny"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, quality int, toxic int")
    got = by_id(url_rules.url_filter(df, none), "page_id", "host", "path", "rule", "verdict")
    for i, u in enumerate(URLS):
        h, p, r, v = brute.url(u)
        assert got[i] == (h, p, r, v or "allow")


def test_mined_url_rules(spark):
    urls = [(i, f"https://{'spam' if i % 4 == 0 else 'good'}.site{i % 3}.com/{'buy' if i % 2 == 0 else 'read'}/{i}") for i in range(400)]
    pages = spark.createDataFrame([*urls, (400, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 300)] + [(None, 0, 0), (1, None, None)], "page_id long, quality int, toxic int")
    got = by_id(url_rules.url_filter(pages, labels), "page_id", "verdict", "n_matched")
    assert all((got[i][0] == "block") == (i % 4 == 0) for i in range(400))
    assert got[400] == ("allow", 0)


def test_mined_url_rules_are_all_used(spark):
    """Sets that hold a bad host don't crowd out rules of three tokens, and rules of four tokens count."""
    common = "w/x/y/z/u/v"
    urls = [(f"http://bad{i}.t/{common}", True) for i in range(60) for _ in range(22)] + [(f"http://good.t/{common}", False)] * 400
    for name in ("abc", "defg"):
        urls += [(f"http://good.t/{'/'.join(name)}", i >= 2) for i in range(40)]
        urls += [(f"http://good.t/{'/'.join(name.replace(x, ''))}", False) for x in name for _ in range(40)]
    last = len(urls)
    rows = [*((i, u) for i, (u, _) in enumerate(urls)), (last, "http://n.t/a/b/c"), (last + 1, "http://n.t/d/e/f/g"), (last + 2, "http://n.t/d/e/f"), (last + 3, "http://bad7.t/w")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(urls)], "page_id long, quality int, toxic int")
    got = by_id(url_rules.url_filter(pages, labels, rules=[], min_rows=20), "page_id", "verdict", "n_matched")
    assert [got[last + i] for i in range(4)] == [("block", 1), ("block", 1), ("allow", 0), ("block", 1)]
    assert all(got[i] == (("block", 1) if i < 1320 else ("allow", 0)) for i in range(1720))
    assert by_id(url_rules.url_filter(pages, labels, rules=[], min_rows=20, max_broadcast=0), "page_id", "verdict", "n_matched") == got


def test_url_rules_of_all_token_sets(spark, monkeypatch):
    """Verdicts are those of trying all sets of tokens, from labels and from host rules; rules are pruned alike either way."""
    rng = random.Random(6)
    hosts = ["a.net", "b.net", "a.com", "c.com", "d.org"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice('xyz')}/{rng.randrange(9)}" + rng.choice(["", "?p=1&q=2", "#t"]) for _ in range(300)]
    urls += ["http://e.net/long/path/of/many/shared/tokens/that/all/pages/of/this/host/have/in/common"] * 30 + [None, "", "x", "http://z.org/shared", urls[0], urls[0]]
    pages = list(enumerate(urls))
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id long, url string, host string, row string")
    bad = {i for i, u in pages if u and ("a.net" in u and "/x/" in u or "shared/tokens" in u or "p=1" in u and "/de/" in u and rng.random() < 0.97)}
    learned = {i for i, _ in pages if i % 7}
    labels = spark.createDataFrame([(i, 1, 1) if i in bad else (i, 1, None) for i in sorted(learned)], "page_id long, quality int, toxic int")
    got = by_id(url_rules.url_filter(df, labels, rules=[], min_rows=4), "page_id", "verdict", "n_matched")
    want = brute.mined_urls(pages, bad, learned, 4)
    assert {i for i, v in got.items() if v[0] == "block"} == want and len(want) > len(bad & learned) - 5
    with monkeypatch.context() as m:
        m.setattr(url_rules.prune, "__defaults__", (1,))
        assert by_id(url_rules.url_filter(df, labels, rules=[], min_rows=4), "page_id", "verdict", "n_matched") == got
    blocked = {i for i, u in pages if brute.url(u)[3] == "block"}
    want = brute.mined_urls(pages, blocked, {i for i, u in pages if brute.url(u)[3]})
    got = by_id(url_rules.url_filter(df), "page_id", "verdict", "n_matched", "rule")
    assert {i for i, v in got.items() if v[1]} == want and any(v[:2] == ("block", 1) and v[2] is None for v in got.values())
    assert all(v[0] == ("block" if i in blocked or i in want and v[2] is None else "allow") for i, v in got.items())


def test_near(tricky, docs):
    got = near_dup.near_duplicates(tricky, k=4)
    same(by_id(got, "doc_id", "n_shingles", "component_id", "kept"), brute.near(docs))
    kept = near_dup.drop_near_duplicates(tricky, k=4)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, r in brute.near(docs).items() if r[2])
    assert kept.columns == tricky.columns


@pytest.mark.parametrize("block,limit", [(512, 256), (8, 3)])
def test_near_groups_that_the_leader_misses(spark, monkeypatch, block, limit):
    """Chains whose ends aren't similar, in one large group: whole, and in blocks with hubs dealt to several tasks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    for module in (common, near_dup):
        monkeypatch.setattr(module, "hub_limit", lambda rows: limit)
    rng = random.Random(9)
    rows, words = [], [f"v{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(120):
        words = list(words)
        for _ in range(3):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    same(by_id(got, "doc_id", "n_shingles", "component_id", "kept"), brute.near(sorted(rows)))


def test_hubs(spark, monkeypatch):
    """A star of 300, a chain from its hub, a pair apart: the components whatever a task may take; and joins keep rows as they are."""
    edges = [(1000, i) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(20)] + [(2001, 2000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (3, 256):
        monkeypatch.setattr(common, "hub_limit", lambda rows, limit=limit: limit)
        got = {r.node: r.comp for r in common.components(common.Shared(spark), df, "t").collect()}
        assert got == {**dict.fromkeys([*range(300), *range(1000, 1021)], 0), 2000: 2000, 2001: 2000}
        one = spark.createDataFrame([(1000, "x"), (2001, "y"), (5, "z")], "a long, t string")
        joined = common.spread_join(df.unionAll(df), one, "a", limit)
        assert joined.columns == ["a", "b", "t"]
        assert sorted(map(tuple, joined.collect())) == sorted([(1000, i, "x") for i in [*range(300), 1001]] * 2 + [(2001, 2000, "y")] * 2)


def test_near_blocks(spark, monkeypatch):
    """Buckets larger than a block are split, and nothing is lost."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(80)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=70)
    same(by_id(got, "doc_id", "n_shingles", "component_id", "kept"), brute.near(rows, percent=70))


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(1, "q r s t u v"), (2, "a b c d e f g"), (None, "x y z u v w"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == 8
    assert {r.component_id for r in got if r.doc_id == 2} == {1}
    kept = near_dup.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "x y z u v w"), (1, "a b c d e f g"), (1, "q r s t u v"), (3, ""), (3, "")]
    spans = span_dup.span_dedup(spark.createDataFrame([(1, "One two three four five. Six seven eight. Nine ten."), ] * 2, "doc_id long, text string"), ["doc_id", "text"])
    assert sorted(r.n_removed for r in spans.collect()) == [0, 3]
    assert ppm.score_texts(df).count() == 8
    assert decontaminate(df, spark.createDataFrame([("i", "a b c d")], "item_id string, text string")).where("contaminated").count() == 4


def test_spans(tricky, docs):
    got = span_dup.span_dedup(tricky, ["doc_id", "text", "score"])
    same(by_id(got, "doc_id", "text", "n_sentences", "n_removed", "words_removed"), brute.sentence_spans(docs))
    assert got.where("score = 0.5").count() == len(docs)


@pytest.mark.parametrize("limit", [0, 2, 5])
def test_spans_that_many_rows_hold(spark, monkeypatch, limit):
    """A passage in every row, twice in some, copies of rows, and spans of few places, above and under the limit of a join."""
    monkeypatch.setattr(span_dup, "hub_limit", lambda rows: limit)
    shared = "This passage stands in every row of the table. It has a second sentence as well. And it ends with a third one here. Then comes yet another."
    rows = [(i, f"Row {i} begins with words of its own today. {shared} {f'Only pair {i // 2} of rows holds this sentence of eight. And this one {i // 2} too. So be it. ' * (1 + (i % 7 == 0))}{shared if i % 5 == 0 else 'The end.'}") for i in range(24)]
    rows += [(30 + i, rows[3][1]) for i in range(4)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(span_dup.span_dedup(df, ["doc_id"]), "doc_id", "text", "n_removed")
    want = brute.sentence_spans(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got[23][1] >= 4 and got[0][1] >= 3 and got[30][1] > 5


def test_covered_runs():
    assert span_dup.covered(np.array([5, 0, 1, 9, 4]), np.array([3, 2, 3, 1, 1])) == [(0, 8), (9, 1)]
    assert span_dup.covered(np.array([3]), np.array([2])) == [(3, 2)]


def test_spans_of_short_sentences(spark):
    """Lists, one-word sentences and Han text repeat as passages; 7 words don't; all spans are what plain Python grows."""
    lists = "".join(f"\n{x}" for x in "ash oak elm fir yew bay box fig gum nut".split())
    han = "".join(f"\n{x}" for x in ("春眠不", "覺曉處", "處聞啼"))
    rows = [(1, f"First page of its own:{lists}\nend"), (2, f"Another page:{lists}\nother end"), (3, f"题{han}\n完"), (4, f"別{han}\n了"), (5, "A. B. C. D. E. F. G. x"), (6, "A. B. C. D. E. F. G. y"), (7, "0.1.2.3.4.5.6 a b. c. d. e. f. g. h"), (8, "9.1.2.3.4.5.6 a b. c. d. e. f. g. h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(span_dup.span_dedup(df, ["doc_id", "text"]), "doc_id", "text", "n_removed")
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0)
    assert got[2] == ("Another page:\nother end", 10) and got[4] == ("別\n了", 3)
    assert got[6] == (rows[5][1], 0)
    assert got[8] == ("9.", 12)
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice(["a", "bb ", "c. ", ".", "\n", "日本", "é"]) for _ in range(rng.randrange(1, 60)))
        parts = [m.group().decode() for m in span_dup.SENTENCE.finditer(t.encode())]
        want = sorted(brute.runs(parts))
        h, at, size, _ = span_dup.spans_of(np.frombuffer(t.encode(), np.uint8), 3, 8, 30)
        assert sorted(zip(at.tolist(), size.tolist(), strict=True)) == want
        keys = [tuple(p.strip() for p in parts[i : i + k]) for i, k in zip(at.tolist(), size.tolist(), strict=True)]
        for half in h:
            assert len({*zip(keys, half.tolist(), strict=True)}) == len({*keys}) == len({*half.tolist()})
        assert not (h[0] == h[1]).any()


def test_spans_keep_clashing_columns(spark):
    """Kept columns may have the operator's inner names; those of the result's names give way."""
    df = spark.createDataFrame([(2, "A b c d e f. G h. I j.", "x", 1, 5), (1, "A b c d e f. G h. I j.", "y", 2, 6), (None, None, None, None, None)], "doc_id long, text string, t string, row int, n_removed int")
    got = span_dup.span_dedup(df, df.columns)
    assert got.columns == ["doc_id", "text", "t", "row", "n_sentences", "n_removed", "words_removed"]
    assert by_id(got, "doc_id", "text", "t", "row", "n_removed") == {2: ("", "x", 1, 3), 1: (df.first().text, "y", 2, 0), None: (None, None, None, 0)}


def test_ppm(tricky, docs):
    got = ppm.score_texts(tricky).cache()
    same(by_id(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), brute.unigram(docs))
    few = ppm.score_texts(tricky, max_common=3, max_grams=40)
    same(by_id(few, "doc_id", "n_tokens", "n_known", "base_score", "score"), by_id(got, "doc_id", "n_tokens", "n_known", "base_score", "score"))
    assert got.where("score > 0 or isnan(score)").count() == 0


def test_ppm_scores(tricky, docs):
    """Every score is the sum that the definition gives, at two orders and with all bytes in the texts."""
    wild = tricky.sparkSession.createDataFrame([(1000 + i, "".join(chr(40 * i + j) for j in range(1, 60)) * 2) for i in range(30)] + [(2000, "Пример русского текста, пример"), (2001, "日本語のテキスト日本")], "doc_id long, text string")
    some = [r for r in docs if not r[1] or len(r[1]) < 100_000]
    rows = [*some, *((r.doc_id, r.text) for r in wild.collect())]
    df = tricky.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 5):
        same(by_id(ppm.score_texts(df, order=order, max_grams=200), "doc_id", "score"), brute.ppm(rows, order))


def test_ppm_orders(spark):
    """Each context's probabilities add up to one, seen or not."""
    rng = np.random.RandomState(1)
    counts = collections.Counter(int(g) for g in rng.choice([0, 1, 2, 9, 256], (3000, 5)) @ (1 << ppm.BITS * np.arange(5)))
    trie = ppm.learn(ppm.Shared(spark), spark.createDataFrame(list(counts.items()), "gram long, n long"), 4)
    contexts = [*{g >> ppm.BITS for g in list(counts)[:20]}, 5, (1 << 4 * ppm.BITS) - 1, 256 << 3 * ppm.BITS | 9]
    grams = spark.createDataFrame([(c << ppm.BITS | s,) for c in contexts for s in range(ppm.SYMBOLS)], "gram long")
    total = collections.Counter()
    for r in trie.values(grams).collect():
        total[r.gram >> ppm.BITS] += 10.0**r.value
    assert len(total) == len(contexts) and np.allclose(list(total.values()), 1, atol=1e-9)


def test_ppm_by_hand(spark):
    """Of "aaab" alone, b has 1/2 after "aaa"; shorter contexts know nothing else, and the other half is shared alike."""
    gram = 97 << 27 | 97 << 18 | 97 << 9 | 98
    trie = ppm.learn(ppm.Shared(spark), spark.createDataFrame([(gram, 1)], "gram long, n long"), 3)
    got = {r.gram: 10.0**r.value for r in trie.values(spark.createDataFrame([(gram,), (gram - 1,), (98,)], "gram long")).collect()}
    assert got[gram] == pytest.approx(0.5) and got[gram - 1] == pytest.approx(0.5 / 256) and got[98] == pytest.approx(0.5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    got = quality_model.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(quality_model.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.quality for r in got) > 0.95 * len(got)
    assert all(0 < r.score < 1 for r in got)


def test_classifier_without_labels(tricky, spark):
    for rows in ([], [(3, None)], [(3, 1), (3, 1), (9, 1)]):
        model = quality_model.train(tricky, spark.createDataFrame(rows, "doc_id long, quality int"))
        got = quality_model.score(tricky, model, ["doc_id", "lang"])
        assert got.count() == tricky.count()
        assert len({r.score for r in got.collect()}) == 1


def test_trees_follow_their_arrays():
    rng = np.random.RandomState(1)
    x = rng.rand(2000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_model.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        out = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.cut[at] else m.right[at]
            out += m.value[at]
        return out

    assert np.allclose(m.margin(x[:50]), [walk(r) for r in x[:50]])


def test_trees_are_the_best_of_all_cuts():
    """Margins are those of trying every cut of every node, ties and constant columns included."""
    rng = np.random.RandomState(3)
    for bins in (4, 16):
        x = np.column_stack([rng.rand(150), rng.randint(0, 4, 150), np.ones(150), rng.randn(150)])
        y = ((x[:, 0] > 0.4) & (x[:, 1] > 1) | (rng.rand(150) < 0.1)).astype(float)
        got = quality_model.fit(x, y, trees=6, depth=3, bins=bins).margin(x)
        assert np.allclose(got, brute.boosted(x.tolist(), y.tolist(), 6, 3, bins), atol=1e-9)


def test_repeated_rows_and_clashing_names(spark):
    """Rows that repeat give equal rows, a result each, and columns named like the results don't matter."""
    texts = ["The MIT License and the Apache License. All rights reserved", "word " * 80, "a b c. d e f\na b c. d e f " * 9, None, ""]
    extra = "lang string, source string, n_words string, labels string, score string, kept string, spans int, predicted int, n_chars int"
    df = spark.createDataFrame([(i, t, "en", None, *"abcd", 1, 2, 3) for i, t in enumerate(texts) for _ in range(2)], f"doc_id long, text string, {extra}")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    model = quality_model.train(df, labels)
    pages = spark.createDataFrame([(i, f"http://a.net/{i}" if i else None, f"<p>{t}</p>" if t else t, "x", 1) for i, t in enumerate(texts) for _ in range(2)], "page_id long, url string, html string, text string, n_chars int")
    for got, key in (
        (licences.licence_scan(df), "doc_id"), (quality_rules.quality_rules(df), "doc_id"), (quality_model.score(df, model, ["doc_id", "text", "score", "n_chars"]), "doc_id"),
        (extract_text(pages, ["page_id", "url", "text", "n_chars"]), "page_id"), (url_rules.url_filter(pages), "page_id"),
    ):
        assert len(set(got.columns)) == len(got.columns)
        rows = collections.Counter(repr(r) for r in got.collect())
        assert len(rows) == len(texts) and set(rows.values()) == {2}, got.columns
        assert got.select(key).distinct().count() == len(texts)


PAGE = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>First   para <b>bold</b>
text.<p>Second<br>one.<div class="ad">Buy</div><aside>More</aside><form><input>Mail</form><script>x="</p>"</script><p>Ti.</p>
<table><tr><td>a<td>b</table></article></main><div id="comments"><p>A reader says a lot of things here, indeed.</p></div><footer>&copy; x</footer></body></html>"""


def test_html():
    assert extract(PAGE) == "Head & line\nFirst para bold text.\nSecond one.\nTi.\na\nb"
    assert extract(None) == extract("") == extract("<p></p>") == extract("<script>a</script>") == ""
    assert extract("plain text") == "plain text"
    assert extract("<article><p>open <b>tags &lt;never&gt; closed &#233;") == "open tags <never> closed é"
    assert extract("<div><p>No article here, only text in a page.</p><p>Second.</p></div><div class=sidebar>Links</div>") == "No article here, only text in a page.\nSecond."
    assert len(extract("<article>" + "<p>word</p>" * 30_000 + "</article>").split("\n")) == 30_000


def test_html_regions_by_ratio():
    """Ratios tell boxes apart where no tag or class does, and the body's text isn't lost beside an article card."""
    text = ["The river rises in the hills above the town and runs for forty miles to the sea.", "In spring it floods the meadows, and the road along its bank is closed for weeks.", "Older people remember when the mill still worked, and its wheel could be heard at night."]
    links = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Sport", "Weather", "Travel")) + "</ul>"
    main = "<div><h2>River</h2>" + "".join(f"<p>{t}</p>" for t in text) + "<ul><li>mill</li><li>bank</li></ul></div>"
    want = "\n".join(["River", *text, "mill", "bank"])
    assert extract(f"<body><div>{links}</div>{main}<div>We use cookies</div><div>{links}</div></body>") == want
    assert extract(f"<body><div>{links}{main}</div><div>All prices include tax</div></body>") == want
    assert extract(f"<body>{main}<article><a href=x>Read this too</a></article></body>") == want
    assert extract(f"<body><article><a href=x>Read this too</a></article>{main}{links}</body>") == want
    assert extract(f"<body><article>{main}</article><div><p>{text[0]}</p></div></body>") == want
    assert extract(links).split("\n") == ["Home", "News", "Sport", "Weather", "Travel"]
    long = "<div><p>" + "word " * 2000 + "</p></div>" + main
    assert extract(f"<body>{long}</body>").endswith(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_html_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = by_id(extract_text(pages, ["page_id", "url"]), "page_id", "text", "n_chars")
    assert got == {r.page_id: (t := brute.article(r.html), len(t)) for r in pages.collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_html_ratios_choose_lines(spark, monkeypatch):
    """Content lines are what the definition gives, and any others change nearly all texts of the tables' pages."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    rng, chosen, want = np.random.RandomState(2), html_text.content_lines, [extract(x) for x in pages]

    def parsed(html):
        p = html_text.Lines()
        p.feed(html)
        p.close()
        p.close_line()
        return p

    cards = "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Sport", "Imprint"))
    made = [f"<body><nav><ul>{cards}</ul></nav><p>{'w ' * rng.randint(60)}</p><article>" + "".join(f"<p>{'word ' * rng.randint(40)}<b>x</b></p>" for _ in range(rng.randint(1, 12))) + f"<ul>{cards}</ul></article><main><p>{'z ' * rng.randint(30)}</p></main></body>" for _ in range(60)]
    for html in pages[:60] + made:
        p = parsed(html)
        at = [i for i, x in enumerate(p.lines) if x[0]]
        got = chosen(p, at, np.array([p.lines[i][2] for i in at]), 1.0, 1.0)[0]
        assert got.tolist() == brute.content([(len(x[0]), x[1], x[2], x[4], x[6]) for x in p.lines])
    monkeypatch.setattr(html_text, "content_lines", lambda p, index, *a: (rng.rand(len(index)) < 0.5, chosen(p, index, *a)[1]))
    assert sum(extract(x) != t for x, t in zip(pages, want, strict=True)) > 0.9 * len(pages)


def test_html_inside_and_at_the_end_of_articles():
    """Text of an article stays whatever its blocks are called, lists of links at its end go."""
    long = "A paragraph of the article that is long enough to count as one by itself, whatever stands beside it in the page."
    for open_, close in (("<div class=search>", "</div>"), ("<div class='social'>", "</div>"), ("<dialog open>", "</dialog>")):
        block = f"{open_}Some words of it.{close}"
        assert extract(f"<article><p>{long}</p>{block}<p>{long}</p></article>") == f"{long}\nSome words of it.\n{long}"
        assert extract(f"<body><p>{long}</p>{block}</body>") == long
    assert extract(f"<article><p>{long} <math><mi>x + 1</mi></math></p></article>") == f"{long} x + 1"
    links = "<ul>" + "".join(f"<li><a href=/{i}>p{i}</a></li>" for i in range(9)) + "</ul>"
    assert extract(f"<body><nav>{links}</nav><article><h1>Head</h1><p>{long}</p><p>{long}</p><p>End.</p>{links}</article></body>") == f"Head\n{long}\n{long}\nEnd."


def test_html_names_are_taken_whole():
    """Class names count as whole names, and text isn't lost because a part of one is a hint."""
    body = "<p>" + "A paragraph of the article that is long enough to be one. " * 3 + "</p>"
    for name in ("post-header", "share-price", "ad-hoc", "navigator", "readers", "headers"):
        assert extract(f"<article>{body}<div class='{name}'><p>Kept.</p></div></article>").endswith("Kept."), name
    for name in ("header", "site-header", "cookie-notice", "x ads", "Ad", "share-buttons", "comments_list", "widget ad-2"):
        assert not extract(f"<article>{body}<div class='{name}'><p>Gone.</p></div></article>").endswith("Gone."), name


def test_html_short_paragraphs():
    """Short paragraphs between long ones stay, with or without an article, and so do headings and lists."""
    long = "A paragraph of the article that is long enough to count as one by itself, whatever stands beside it in the page."
    parts = ["<h1>Head</h1>", f"<p>{long}</p>", "<p>No.</p>", "<p>Yes.</p>", "<p>Well.</p>", f"<p>{long}</p>", "<ul><li>one</li><li>two</li></ul>", f"<p>{long}</p>", "<p>End.</p>"]
    want = "\n".join(["Head", long, "No.", "Yes.", "Well.", long, "one", "two", long, "End."])
    links = "<div>" + "".join(f"<p><a href=x>{w}</a></p>" for w in ("Home", "News", "Sport", "Imprint", "Privacy")) + "</div>"
    for tag in ("article", "div", "section"):
        assert extract(f"<body>{links}<{tag}>{''.join(parts)}</{tag}>{links}</body>") == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_html_ratios_decide(spark, monkeypatch):
    """Without telling tags, ratios find the same text as the tags do, and a random choice of lines doesn't."""
    from atrium.llm import html_text

    rng = np.random.RandomState(1)
    bare = re.compile("(</?)(?:article|nav|footer)")
    pages = [(r.html, bare.sub(r"\1div", r.html).replace(' class="ad"', "")) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [extract(b) for _, b in pages]
    lost = [len(set(extract(a).split("\n")) - set(b.split("\n"))) for (a, _), b in zip(pages, plain, strict=True)]
    assert not any(lost)
    assert sum(len(b.split("\n")) <= len(extract(a).split("\n")) + 2 for (a, _), b in zip(pages, plain, strict=True)) == len(pages)  # no link list, at most the notice and the footer's sentence
    real = html_text.content_lines
    monkeypatch.setattr(html_text, "content_lines", lambda *a: (rng.rand(len(a[1])) < 0.5, real(*a)[1]))
    changed = sum(extract(b) != x for (_, b), x in zip(pages, plain, strict=True))
    assert changed > 0.5 * len(pages), changed


def test_leaks(tricky, docs, spark):
    long = next(t for _, t in docs if t and len(t) > 100_000).split()
    items = [("a", " ".join(long[100:130])), ("b", "a"), ("c", None), ("d", ""), (None, "w1 w2"), ("e", "General public license"), ("f", " ".join(long[100:130])), ("f", "É"), ("g", "shared PASSAGE starts here: now it goes on for a while and it ends")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, n_words int")
    want = brute.leaks(docs, [x for x in items if x[0] is not None])
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(by_id(decontaminate(tricky, bench), "doc_id", *cols), want)
    for openings in (0, 100):
        same(by_id(decontaminate(tricky, bench, max_broadcast=3, max_openings=openings), "doc_id", *cols), want)
    clean = clean_documents(tricky, bench)
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [i for i, w in sorted(want.items()) if not w[4]]
    assert clean.columns == tricky.columns
    shuffled = clean_documents(tricky, bench, max_broadcast_rows=0)
    assert sorted(r.doc_id for r in shuffled.select("doc_id").collect()) == sorted(r.doc_id for r in clean.select("doc_id").collect())
    none = by_id(decontaminate(tricky, bench.where("false")), "doc_id", *cols)
    assert all(v[1:3] == (0, 0) and not v[4] for v in none.values())


def test_columns_named_like_keys(spark):
    """Columns called as the filters call their own ones stay as they are."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, 5, "a"), (2, words, 6, "b"), (3, "w1 w2 w3 clean words " + words[60:], 7, "c"), (4, None, 8, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, `__KEY_` string")
    bench = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(12)))], "item_id string, text string")
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.drop("text").collect()) == [(3, 7, "c"), (4, 8, "d")]
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.drop("text").collect()) == [(1, 5, "a"), (3, 7, "c"), (4, 8, "d")]


def test_leaks_stay_native(tricky, spark):
    bench = spark.createDataFrame([("a", "x y z")], "item_id string, text string")
    plan = decontaminate(tricky, bench)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_empty_tables(tricky, spark):
    none = tricky.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", "x y z")], "item_id string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for got in (
        licences.licence_scan(none), mixing.mix_sources(none, ["doc_id"]), quality_rules.quality_rules(none), url_rules.url_filter(pages), url_rules.url_filter(pages, labels, label_id="doc_id"), near_dup.near_duplicates(none), span_dup.span_dedup(none, ["doc_id"]),
        ppm.score_texts(none), quality_model.score(none, quality_model.train(none, labels), ["doc_id"]), extract_text(pages, ["page_id"]), decontaminate(none, bench),
    ):
        assert got.count() == 0


@pytest.mark.skipif(not glob.glob(DATA), reason="no test data")
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        out = stage(spark, kept, DATA)
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert set(after) <= set(before)
        if name == "near_dedup":
            want = brute.near(sorted(before.items()), k=5)
            assert set(after) == {i for i, w in want.items() if w[2]}
        elif name == "substring_dedup":
            want = brute.sentence_spans(sorted(before.items()))
            assert after == {i: w[0] for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        elif name == "decontamination":
            want = brute.leaks(sorted(before.items()), bench)
            assert set(after) == {i for i, w in want.items() if not w[4]}
        elif name == "mix":
            assert set(after) == set(before)
            assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.1)
        if name != "mix":
            assert out.columns == pipeline.COLUMNS
            kept = spark.createDataFrame(rows, out.schema)
    assert pipeline.run(spark, DATA).count() == len(rows)


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, null ids, other columns, no labels, then no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    long, copy = " ".join(f"w{i}" for i in range(20_000)), " ".join(f"a{i}" for i in range(12))
    passage = " Shared passage starts here now. It goes on for a while. And it ends here."
    own = [" ".join(f"{c}{i}" for i in range(60)) + "." for c in "xyz"]
    rows = [(None, None, None, None)] * 2 + [(1, "", "en", "a"), (2, long, None, "b"), (3, copy, "en", "a"), (3, copy, "en", "a"), (4, copy, "de", None), (None, own[2], "en", "b"), (5, own[0] + passage, "en", "a"), (6, own[1] + passage, "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s", 7, 8, 9.0, "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, size int, predicted int, score double, taken string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", " ".join(long.split()[90:120])), (None, copy), ("n", None), ("e", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda rs: sorted((r.doc_id or 0, r.text or "") for r in rs)
    want = sorted((r[0] or 0, r[1] or "") for r in rows)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}")
        got = out.collect()
        if name == "near_dedup":
            want.remove((3, copy)), want.remove((4, copy))
        elif name == "substring_dedup":
            want = sorted((i, own[1] + " " if i == 6 else t) for i, t in want)  # a blank belongs to the sentence before it
            assert [r.n_chars for r in got if r.doc_id == 6] == [len(own[1]) + 1]
        elif name == "decontamination":
            want.remove((2, long))
        assert ids(got) == want, name
        if name != "mix":
            assert out.columns == pipeline.COLUMNS
            docs = spark.createDataFrame(got, out.schema)
    assert all(r.taken == r["size"] * r.copies for r in got)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    none = pipeline.run(spark, f"{tmp_path}")
    assert none.count() == 0 and "taken" in none.columns


def test_flow_is_cheapest():
    """As many words as any routing, at the least cost, by trying all routings."""
    rng = random.Random(3)
    for _ in range(25):
        supply = [rng.randrange(3) for _ in range(3)]
        members = [sorted(rng.sample(range(3), rng.choice([1, 2]))) for _ in supply]
        quota = [rng.randrange(4) for _ in range(3)]
        links = [(p, s) for p, own in enumerate(members) for s in own]

        def cost(flow, supply=supply):
            sent = [sum(f for (p, _), f in flow.items() if p == q) for q in range(3)]
            return sum(k // supply[q] + 1 for q in range(3) for k in range(sent[q]))

        def fits(flow, supply=supply, quota=quota):
            return all(sum(f for (p, _), f in flow.items() if p == q) <= 2 * supply[q] for q in range(3)) and all(sum(f for (_, s), f in flow.items() if s == q) <= quota[q] for q in range(3))

        tried = [dict(zip(links, f, strict=True)) for f in itertools.product(*(range(min(2 * supply[p], quota[s]) + 1) for p, s in links))]
        best = min((-sum(f.values()), cost(f)) for f in tried if fits(f))
        got = mixing.min_cost_flow(supply, members, quota, 2)
        assert fits(got) and (-sum(got.values()), cost(got)) == best


def test_flow_of_many_patterns():
    rng = random.Random(4)
    supply = [rng.randrange(1, 10**6) for _ in range(60_000)]
    members = [sorted(rng.sample(range(300), rng.randrange(1, 5))) for _ in supply]
    quota = [rng.randrange(sum(supply) // 100) for _ in range(300)]
    sent = collections.Counter()
    for (p, s), f in mixing.min_cost_flow(supply, members, quota, 3).items():
        assert s in members[p] and f > 0
        sent[p] += f
        sent["to", s] += f
    assert all(sent[p] <= 3 * n for p, n in enumerate(supply))
    assert all(sent["to", s] <= q for s, q in enumerate(quota))
