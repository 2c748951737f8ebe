"""Plain Python versions of the contracts, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def shingles(text, k):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows, k, percent):
    """{id: (size, component)} of (id, text) rows."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, u in sets[x + 1:] if s and u and 100 * len(s & u) >= percent * len(s | u)]
    comp = roots({i for i, _ in sets}, links)
    return {i: (len(s), comp[i]) for i, s in sets}


def spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def span_digest(text):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans(text)).encode()).hexdigest()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def lm_base(rows):
    """{id: (n_tokens, n_known, N, base)} of (id, text) rows."""
    toks = {i: [*WORD.findall(low(t)), None] for i, t in rows}
    c = Counter(x for i, ts in toks.items() if crc(i, 7) != 2 for x in ts)
    n, v = sum(c.values()), len(c)
    return {i: (len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for i, ts in toks.items()}


def discounts(counts):
    n = [0, *(sum(c == k for c in counts) for k in (1, 2, 3, 4))]
    if min(n[1:4]) <= 0:
        return [0, 0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
    return [min(max(x, lo), hi) for x, lo, hi in zip(d, (0, 0.1, 0.2, 0.3), (0, 0.95, 1.9, 2.85), strict=True)]


def kneser_ney(texts, order=3, below=None):
    """Interpolated modified Kneser-Ney: a function from tokens to their probabilities. Trigrams and what follows a
    text's start have their counts; other pairs count the distinct words before them, words likewise."""
    tri, pair = Counter(), Counter()
    for ts in texts:
        if order == 3:
            tri.update(zip(["<s>", *ts], ts, ts[1:], strict=False))
            pair["<s>", ts[0]] += 1
        else:
            pair.update(zip(["<s>", *ts], ts, strict=False))
    for _, v, w in tri:
        pair[v, w] += 1
    cont = Counter(w for _, w in pair)

    def followed(grams):
        total, few = Counter(), {}
        for g, c in grams.items():
            total[g[:-1]] += c
            few.setdefault(g[:-1], Counter())[min(c, 3)] += 1
        d = discounts(grams.values())

        def level(g, low):
            ctx, c = g[:-1], grams[g]
            return (c - d[min(c, 3)]) / total[ctx] + sum(d[k] * n for k, n in few[ctx].items()) / total[ctx] * low if total[ctx] else low

        return level

    d1, total = discounts(cont.values()), sum(cont.values())
    held = sum(d1[min(c, 3)] for c in cont.values()) / total if total else 1.0
    second, third = followed(pair), followed(tri)

    def p(ts):
        out, u, v = [], None, "<s>"
        for w in ts:
            low = below(w) if below else 1 / (len(cont) + 1)
            low = second((v, w), (cont[w] - d1[min(cont[w], 3)]) / total + held * low if total else low)
            out.append(third((u, v, w), low) if order == 3 and u is not None else low)
            u, v = v, w
        return out

    return p


def tokens_of(t):
    return [*WORD.findall(low(t)), None]


def lm_scores(rows, order=3):
    """{id: log10 probability} of (id, text) rows."""
    toks = {i: tokens_of(t) for i, t in rows}
    p = kneser_ney([ts for i, ts in toks.items() if crc(i, 7) != 2], order)
    return {i: sum(map(math.log10, p(ts))) for i, ts in toks.items()}


def toxic_ratio(toxic, ordinary, clear, chance):
    """A function from tokens to the mean log ratio: both classes' words over the words of all, below all pairs."""
    firm = lambda c: min(c, 3)
    pair = Counter(p for ts in [*toxic, *ordinary] for p in zip(["<s>", *ts], ts, strict=False))
    total, low = Counter(), Counter()
    for (v, _), c in pair.items():
        total[v] += c
        low[v] += firm(c)

    def words(texts, below):
        cont = Counter(w for _, w in {p for ts in texts for p in zip(["<s>", *ts], ts, strict=False)})
        n, held = sum(cont.values()), sum(map(firm, cont.values()))
        f = lambda w: (cont[w] - firm(cont[w]) + held * below(w)) / n
        f.cont, f.n = cont, n
        return f

    vocabulary = {w for ts in [*toxic, *ordinary] for w in ts}
    every = words([*toxic, *ordinary], lambda w: 1 / (len(vocabulary) + 1))
    classes = [words(x, every) for x in (toxic, ordinary)]

    def differs(w):
        a, b = (c.cont[w] for c in classes)
        share = classes[0].n / (classes[0].n + classes[1].n)
        return (a - (a + b) * share) ** 2 >= chance * max(a + b, 1) * share * (1 - share)

    def x(ts):
        out = 0.0
        for v, w in zip(["<s>", *ts], ts, strict=False):
            p = [(pair[v, w] - firm(pair[v, w]) + low[v] * c(w)) / total[v] if total[v] else c(w) for c in classes]
            d = math.log(p[0] / p[1])
            out += d if abs(d) >= clear and differs(w) else 0.0
        return out / len(ts)

    return x


def host_ranks(edges, seeds, rounds, damping):
    """{host: score}: damped rounds from ``seeds`` along weighted (src, dst, n)."""
    out = Counter()
    for s, _, n in edges:
        out[s] += n
    rank = dict(seeds)
    for _ in range(rounds):
        new = Counter({h: (1 - damping) * v for h, v in seeds.items()})
        for s, d, n in edges:
            new[d] += damping * rank.get(s, 0.0) * n / out[s]
        rank = {h: v for h, v in new.items() if v}
    return rank
