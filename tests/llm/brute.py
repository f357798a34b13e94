"""Slow versions of the operators, row by row, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------ near duplicates


def fingerprint(text):
    own = words(lowered(text))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 4]).encode(), 42) for i in range(max(1, len(own) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def near_classes(rows):
    """[(doc_id, text)] -> [(doc_id, fingerprint, component_id)] and the component number of each row."""
    prints = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)].append(doc)
    out = [(d, f"{prints[i]:016x}", min(ids[top(i)], default=None)) for i, (d, _) in enumerate(rows)]
    return out, [top(i) for i in range(len(rows))]


# -------------------------------------------------------------------- repeats


def repeat_cover(rows, width=13):
    """[(doc_id, text)] -> for each row its words and which of them are removed."""
    least = {}
    cut = [words(t) for _, t in rows]
    for (doc, _), own in zip(rows, cut):
        if doc is not None:
            for i in range(len(own) - width + 1):
                key = tuple(own[i : i + width])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, cut):
        covered = [False] * len(own)
        for i in range(len(own) - width + 1):
            if doc is not None and least[tuple(own[i : i + width])] < doc:
                covered[i : i + width] = [True] * width
        out.append((own, covered))
    return out


def repeat_rows(rows):
    out = []
    for (doc, _), (own, covered) in zip(rows, repeat_cover(rows)):
        kept = " ".join(w for w, c in zip(own, covered) if not c)
        out.append((doc, len(own), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return out


# -------------------------------------------------------------------- quality


def base_counts(text):
    own = words(text)
    windows = list(zip(own, own[1:], own[2:]))
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def quality(rows, least=30, support=0.6, floors=(0.05, 0.03, 0.05, 0.05), cut=47.8794556744147):
    """[(text, lang, source)] -> kept, by an estimate in plain loops over groups."""
    counts = [base_counts(t) for t, _, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    x = np.array([
        (math.log(max(c[1], 1) / max(c[0], 1)), math.sqrt(c[2] / max(c[1], 1)),
         math.sqrt(c[3] / max(c[5], 1)), math.sqrt(c[4] / max(c[0], 1))) for c in counts
    ]).reshape(-1, 4)
    size = collections.Counter((r[1], r[2]) for r, f in zip(rows, failed) if not f)
    pool = collections.Counter()
    for (lang, _), n in size.items():
        pool[lang] += n if n < least else 0
    rest = sum(n for n in pool.values() if n < least)

    def group(row):
        if (row[1], row[2]) not in size:
            return None
        if size[row[1:]] >= least:
            return row[1:]
        return (row[1],) if pool[row[1]] >= least else ("rest",) if rest >= least else None

    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        if not failed[i] and group(row):
            groups[group(row)].append(i)
    far = np.zeros(len(rows))
    state = {}
    for g, own in groups.items():
        y = np.sort(x[own], axis=0)
        low, mid, high = (y[max(0, math.ceil(p * len(own)) - 1)] for p in (0.25, 0.5, 0.75))
        state[g] = (mid, np.diag(((high - low) / 1.349) ** 2) + np.diag(np.square(floors)))
    p6 = lambda q: 1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8)
    q = next(i / 1e5 for i in range(10**7) if 1 - math.exp(-i / 2e5) * (1 + i / 2e5) >= support)
    least = None
    while True:
        for g, own in groups.items():
            centre, cov = state[g]
            d = np.einsum("ij,jk,ik->i", x[own] - centre, np.linalg.inv(cov), x[own] - centre)
            near = d <= np.sort(d)[max(0, math.ceil(support * len(own)) - 1)]
            y = x[own][near]
            state[g] = (y.mean(axis=0), np.cov(y.T, bias=True) * support / p6(q) + np.diag(np.square(floors)))
        now = {g: np.linalg.slogdet(c)[1] for g, (_, c) in state.items()}
        if least is not None and all(least[g] - now[g] < 1e-3 for g in now):
            break
        least = {g: min(v, (least or now)[g]) for g, v in now.items()}
    for g, own in groups.items():
        centre, cov = state[g]
        far[own] = np.einsum("ij,jk,ik->i", x[own] - centre, np.linalg.inv(cov), x[own] - centre)
    return [not f and d <= cut for f, d in zip(failed, far)]


# ---------------------------------------------------------------------- mixing


def copies(doc, text, number, rate):
    """Of the row that has this number, from 0, among rows with its id, text and source."""
    digest = hashlib.md5((text or "").encode()).hexdigest()
    key = ":".join(["mix-1", *([] if doc is None else [str(doc)]), digest, str(number)])
    draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
    whole = math.floor(rate)
    return whole + (draw < rate - whole)


def rates(rows):
    """[(source, words)] -> source: rate, by sharing the excess again and again."""
    size = collections.Counter()
    for source, n in rows:
        size[source] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= above
    return {s: target[s] / size[s] if size[s] else 0.0 for s in order}


# --------------------------------------------------------------------- scoring


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def scores(rows):
    """[(doc_id, text)] -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    tokens = [[*words(lowered(t)), None] for _, t in rows]
    count = collections.Counter(w for (d, _), own in zip(rows, tokens) if not held_out(d) for w in own)
    total, kinds = sum(count.values()), len(count)
    after = [collections.defaultdict(collections.Counter) for _ in range(4)]
    framed = [b"\xff\xff\xff" + lowered(t).encode() + b"\xff" for _, t in rows]
    for (doc, _), x in zip(rows, framed):
        for p in range(3, len(x) if not held_out(doc) else 0):
            for k in range(4):
                after[k][x[p - k : p]][x[p]] += 1

    def chance(context, byte):
        known, mass = set(), 1.0
        for k in (3, 2, 1, 0):
            own = after[k].get(context[3 - k :], {})
            own = {b: n for b, n in own.items() if b not in known}
            if own:
                if byte in own:
                    return mass * own[byte] / (sum(own.values()) + len(own))
                mass *= len(own) / (sum(own.values()) + len(own))
                known |= set(own)
        return mass / (256 - len(known))

    return [
        (doc, held_out(doc), len(own), sum(count[w] > 0 for w in own), total,
         sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own),
         sum(math.log10(chance(x[p - 3 : p], x[p])) for p in range(3, len(x))))
        for (doc, _), own, x in zip(rows, tokens, framed)
    ]
