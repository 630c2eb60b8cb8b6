"""Plain Python versions of the contracts, without the operators' code."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def low(text):
    return (text or "").translate(LOW)


def licences(text):
    w = ALNUM.findall(low(text))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def rules(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def url(u):
    head, sep, rest = (u or "").partition("://")
    if not sep:
        host = path = ""
    else:
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[re.match(r"[^/?#]*", rest).end() :])[0]
    best = None
    for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best and best[1]


def url_tokens(u):
    host, path = url(u)[:2]
    if not host:
        return set()
    query = re.search(r"\?([^#]*)", u)
    parts = [("scheme:", re.match(r"([A-Za-z]*)(?=://)", u)[0] if re.match(r"([A-Za-z]*)://", u) else "")]
    for kind, text, cut in (("host:", host, r"\."), ("path:", path.lower(), "[/._-]"), ("query:", query[1].lower() if query else "", "[&=]")):
        parts += [(kind, "0" if re.fullmatch("[0-9]+", x) else x) for x in re.split(cut, text) if x]
    return {a + b for a, b in parts}


def mined_urls(pages, bad, learned, min_rows=10, min_support=0.002, min_confidence=0.9):
    """Ids of (id, url) that a set of tokens gives away: frequent in bad pages, confident, with no part that is as good; all sets are tried."""
    tokens = {i: frozenset(url_tokens(u)) for i, u in pages}
    known = [(tokens[i], i in bad) for i, u in pages if i in learned and tokens[i]]
    least = max(min_rows, math.ceil(min_support * len(known)))
    often = {t for t, n in Counter(t for s, b in known if b for t in s).items() if n >= least}
    hits = Counter(c for s, b in known if b for n in range(1, len(s & often) + 1) for c in map(frozenset, itertools.combinations(sorted(s & often), n)))
    sure = {}
    for s in (s for s, n in hits.items() if n >= least):
        n = sum(s <= t for t, _ in known)
        if hits[s] >= n * min_confidence:
            sure[s] = hits[s] / n
    rules = [s for s, c in sure.items() if not any(z < s and d >= c for z, d in sure.items())]
    return {i for i, t in tokens.items() if any(s <= t for s in rules)}


def shingles(text, k=4):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows, k=4, percent=80):
    """(id, n, component, kept) of (id, text) rows with distinct ids: all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    groups = defaultdict(list)
    for i, s in sets.items():
        groups[frozenset(s)].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    reps = []
    for s, ids in groups.items():
        if s:
            reps.append((ids[0], s))
            for i in ids[1:]:
                tie(ids[0], i)
    index = defaultdict(list)
    for n, (_, s) in enumerate(reps):
        for x in s:
            index[x].append(n)
    for n, (i, s) in enumerate(reps):
        shared = Counter(m for x in s for m in index[x] if m < n)
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(reps[m][1]) - both):
                tie(i, reps[m][0])
    least = {}
    for i in sets:
        least[find(i)] = min(least.get(find(i), i), i)
    return {i: (len(s), least[find(i)], least[find(i)] == i) for i, s in sets.items()}


def unigram(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    toks = {i: [*SPACED.findall(low(t)), None] for i, t in rows}
    c = Counter(x for i in toks if not held[i] for x in toks[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in toks.items()}


def ppm(rows, order, symbols=257):
    """log10 probability of each text, by the definition: counts in dictionaries, what was seen at a longer context excluded below."""
    body = {i: low(t).encode() for i, t in rows}
    end = "end"
    follow = defaultdict(Counter)

    def steps(b):
        seq = [end] * order + list(b) + [end]
        return [(tuple(seq[j - order : j]), seq[j]) for j in range(order, len(seq))]

    for i, b in body.items():
        if zlib.crc32(str(i).encode()) % 10:
            for ctx, s in steps(b):
                for k in range(order + 1):
                    follow[ctx[order - k :]][s] += 1

    def share(ctx, s, gone=frozenset()):
        here = {x: n for x, n in follow.get(ctx, {}).items() if x not in gone}
        total, kinds = sum(here.values()), len(here)
        if kinds == symbols - len(gone):
            kinds = 0
        if s in here:
            return here[s] / (total + kinds)
        left = kinds / (total + kinds) if total else 1
        gone = gone | set(here)
        return left * (share(ctx[1:], s, gone) if ctx else 1 / (symbols - len(gone)))

    known: dict = {}
    for step in (x for b in body.values() for x in steps(b)):
        if step not in known:
            known[step] = math.log10(share(*step))
    return {i: (math.fsum(known[x] for x in steps(b)),) for i, b in body.items()}


def leaks(docs, items, size=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[j : j + k])].add(i)
    out = {}
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                got = wins.get(tuple(w[j : j + k]))
                if got:
                    hit |= set(range(j, j + k))
                    ids |= got
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


def mix_targets(sizes, cap=3, total=None):
    """Targets of sources in order, by exact rationals."""
    from fractions import Fraction

    total, fixed = sum(sizes) if total is None else total, {}
    weights = [i % 3 + 1 for i in range(len(sizes))]
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed and sizes[i]]
        w = sum(weights[i] for i in free) or 1
        over = [i for i in free if Fraction(left * weights[i], w) > cap * sizes[i]]
        if not over:
            return [float(fixed.get(i, Fraction(left * weights[i], w) if i in free else 0)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


HAN = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^\x20\x09-\x0D\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def runs(s, run=3, min_words=8, long_words=30):
    """(first, size) of the spans of a text's sentences."""
    ends = list(itertools.accumulate(map(len, s), initial=0))
    begins = [m.start() for m in HAN.finditer("".join(s))]
    upto = [sum(b < e for b in begins) for e in ends] if len(begins) < 2000 else [bisect.bisect_left(begins, e) for e in ends]
    out = []
    for j in range(len(s)):
        sizes = [n for n in range(1, min(run, len(s) - j) + 1) if upto[j + n] - upto[j] >= (min_words if n == run else long_words)]
        if j + run <= len(s) and run not in sizes:
            sizes += [n for n in range(run + 1, len(s) - j + 1) if upto[j + n] - upto[j] >= min_words][:1]
        out += [(j, n) for n in sizes]
    return out


def sentence_spans(rows):
    """(id, text, sentences, removed, words) of (id, text) rows in order."""
    cut = re.compile(r"[^.!?\n]*[.!?\n][.!?\x20\t\n\r\f\v]*|[^.!?\n]+\Z")
    parts = {i: cut.findall(t or "") for i, t in rows}
    seen, drop = set(), defaultdict(set)
    for i in sorted(parts):
        s = parts[i]
        for j, n in runs(s):
            key = tuple(x.strip("\x20\t\n\r\f\v") for x in s[j : j + n])
            if key in seen:
                drop[i] |= set(range(j, j + n))
            seen.add(key)
    out = {}
    for i, t in rows:
        s = parts[i]
        gone = [x for j, x in enumerate(s) if j in drop[i]]
        out[i] = (None if t is None else "".join(x for j, x in enumerate(s) if j not in drop[i]) if gone else t, len(s), len(gone), sum(len(SPACED.findall(x)) for x in gone))  # words of what went
    return out


class Article(HTMLParser):
    """Blocks inside article, for pages whose markup is known to be simple."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " " if self.inside else ""

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    return "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in p.blocks) if x)


def content(lines, sigma=1.0, cut=1.0, plain=100.0):
    """Which lines with text are content, from (characters, tags, region, characters in links, silent characters) of all lines, without arrays."""

    def smoothed(v):
        r = math.ceil(2 * sigma)
        w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
        return [sum(w[k + r] * v[min(max(i + k, 0), len(v) - 1)] for k in range(-r, r + 1)) / sum(w) for i in range(len(v))]

    def spread(v):
        return math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))

    at = [i for i, x in enumerate(lines) if x[0]]
    plainly, capped = smoothed([x[0] / max(1, x[1]) for x in lines]), smoothed([min(x[0] / max(1, x[1]), plain) for x in lines])
    whole = smoothed([(x[0] + x[4]) / max(1, x[1]) for x in lines])
    links = [whole[i] for i, x in enumerate(lines) if x[0] + x[4] > 0 and 2 * x[3] > x[0] + x[4]]
    weak = sum(links) / len(links) if links else 0.0
    marked, body = ([v[i] for i in at] for v in (plainly, capped))
    sure = {i for i in at if (plainly[i] >= min(cut * spread(marked), max(marked)) if lines[i][2] else capped[i] >= min(cut * spread(body), max(body)))}
    for region in {lines[i][2] for i in sure} - {0}:
        own = [i for i in at if lines[i][2] == region]
        lo, hi = own.index(min(sure & set(own))), own.index(max(sure & set(own)))
        while lo and whole[own[lo - 1]] >= weak:
            lo -= 1
        while hi + 1 < len(own) and whole[own[hi + 1]] >= weak:
            hi += 1
        sure |= set(own[lo : hi + 1])
    return [i in sure for i in at]


def boosted(x, y, trees, depth, bins, rate=0.2, ridge=1.0, least=1.0):
    """Margins of boosted trees: every cut of every feature is tried on the rows of a node, with sums over those rows."""
    n, cols = len(y), range(len(x[0]))
    cuts = [sorted({float(q) for q in np.quantile([r[j] for r in x], [k / bins for k in range(1, bins)])}) for j in cols]
    start = (sum(y) + 0.5) / (n + 1)
    margin = [math.log(start / (1 - start))] * n

    def worth(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + ridge)

    def leaves(rows, level, g, h):
        best, parts = 1e-4, None
        for j, c in ((j, c) for j in cols for c in cuts[j]) if level else ():
            low, high = [i for i in rows if x[i][j] <= c], [i for i in rows if x[i][j] > c]
            if min(sum(h[i] for i in low), sum(h[i] for i in high)) >= least:
                gain = worth(low, g, h) + worth(high, g, h) - worth(rows, g, h)
                if gain > best:
                    best, parts = gain, (low, high)
        return [leaf for part in parts for leaf in leaves(part, level - 1, g, h)] if parts else [rows]

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-6) for a in p]
        for rows in leaves(list(range(n)), depth, g, h):
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                margin[i] += step
    return margin


def licence_spans(text, templates, least=4, gap=6):
    """(label, start, end, covered) of a text: where the longest piece of any template that ends at a word can't go on, it is a match; matches of a template in its order make a span."""
    words, seqs = ALNUM.findall(low(text)), [ALNUM.findall(low(t)) for _, t in templates]
    pieces = defaultdict(dict)
    for t, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                pieces[tuple(s[i:j])].setdefault(t, i)
    found, size = defaultdict(list), 0
    for i in range(len(words) + 1):
        now = 0 if i == len(words) else next(k for k in range(size + 1, -1, -1) if not k or tuple(words[i - k + 1 : i + 1]) in pieces)
        if size >= least and now <= size:
            for t, place in pieces[tuple(words[i - size : i])].items():
                found[t].append((i - size, i, place, place + size))
        size = now
    for t, s in enumerate(seqs):
        if len(s) < least:
            found[t] = [(i, i + len(s), 0, len(s)) for i in range(len(words) - len(s) + 1) if s and words[i : i + len(s)] == s]
    out = []
    for t, matches in found.items():
        spans = []
        for m in sorted(matches):
            if spans and m[0] - spans[-1][-1][1] <= gap and m[2] >= spans[-1][-1][3]:
                spans[-1].append(m)
            else:
                spans.append([m])
        for x in spans:
            covered = len({w for a, b, *_ in x for w in range(a, b)})
            out.append((templates[t][0], x[0][0], x[-1][1], min(1.0, covered / len(seqs[t]))))
    return sorted(out)


def audit(rows, labels):
    """{(part, order, step): counts} by applying the five filters in each order; rows are (doc_id, text, lang)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(SPACED, t)
        fails.append((lang or "", d, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }))
    out = {}
    for part in {p for p, _, _ in fails}:
        first = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [(d, f) for p, d, f in fails if p == part], []
            for step, x in enumerate(order, 1):
                lost = [d for d, f in left if f[x]]
                redundant = sum(f[x] for f in gone)
                gone += [f for _, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                alone = sum(f[x] and sum(f.values()) == 1 for p, _, f in fails if p == part)
                out[part, order, step] = (len(left), len(lost), redundant, alone, sum(d in good for d in lost), sum(d in toxic for d in lost))
                first[x] += len(lost)
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, first[order[step - 1]])
    return out


def exact_copies(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha256); rows are (doc_id, text)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        stays = ids.index(keep)
        out += [(d, keep, len(ids), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def lloyd(rows, k=16, rounds=3, dims=64, scale=64):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python's integers; rows are (vec_id, vector)."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), raw, v) for i, v, raw in kept if i is not None)
    cents = [v for _, _, v in named[:k]]
    if not cents:
        return []

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [place(v)[1] for _, v, _ in kept]
        for j in range(len(cents)):
            own = [v for (_, v, _), c in zip(kept, of, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *place(v)) for i, v, _ in kept]
    per = Counter()
    for _, d, c in found:
        per[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fit(d), fit(per[c]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in found), key=repr)
