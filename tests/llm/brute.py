"""Plain forms of the operators, row by row in memory."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile("[^\x20\x09-\x0d]+")


def hash64(*values):
    """Spark's chained xxhash64 of strings and longs, signed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def statistics(text):
    words = WORDS.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def quality(rows):
    """``rows`` of (doc_id, text, lang, source): verdicts in order."""
    stats = [statistics(t) for _, t, _, _ in rows]
    failed = [s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"] for s in stats]

    def measures(s):
        return {
            "symbols": 1000 * s["n_symbols"] // s["n_words"],
            "dup_lines": 1000 * s["n_dup_lines"] // max(s["n_lines"], 1),
            "repeats": 1000 * s["n_repeat_words"] // s["n_words"],
            "word_length": 100 * s["word_chars"] // s["n_words"],
        }

    groups = defaultdict(list)
    for (_, _, lang, source), s, bad in zip(rows, stats, failed):
        if not bad:
            for name, v in measures(s).items():
                v -= v % (1 << max(v.bit_length() - 6, 0))
                for g in ((0, lang, source), (1, lang, None), (2, None, None)):
                    groups[(*g, name)].append(v)

    ranks = (250, 500, 750, 998)

    def quantiles(g):
        values = sorted(groups[g])
        low = [values[-(-k * len(values) // 1000) - 1] for k in ranks]
        return len(values), [v + (1 << max(v.bit_length() - 6, 0)) - 1 if k > 500 else v for v, k in zip(low, ranks)]

    def blend(n, own, parent):
        return [(n * a + 100 * b) // (n + 100) for a, b in zip(own, parent)]

    found = {g: quantiles(g) for g in groups}
    out = []
    for (_, _, lang, source), s, bad in zip(rows, stats, failed):
        kept = not bad
        for name, v in measures(s).items() if kept else ():
            up = blend(*found[(1, lang, None, name)], found[(2, None, None, name)][1])
            q25, q50, q75, tail = blend(*found[(0, lang, source, name)], up)
            if name in ("dup_lines", "repeats"):
                kept &= v <= tail
            else:
                kept &= v <= q75 + 6 * (q75 - q50) + (200 if name == "symbols" else 0)
            kept &= name != "word_length" or v >= q25 - 6 * (q50 - q25)
        out.append((s, bad, kept))
    return out


def drop_lines(rows):
    """``rows`` of (doc_id, text): (text, n_lines, n_dropped) in order; doc_ids are distinct or their rows equal."""
    lines, holders, leaf_lines, exact = [], defaultdict(set), Counter(), defaultdict(list)
    for i, (d, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n") if text is not None else ()):
            words = tuple(WORDS.findall(line))
            if words:
                exact[words].append((d is None, d or 0, k, i))
            if len(words) >= 3:
                masked = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
                lines.append((i, d, k, masked))
                holders[masked].add((d, text))
                leaf_lines[len(masked), masked[:3]] += 1

    def ways(masked):
        return [(len(masked), tuple("<*>" if i == p else w for i, w in enumerate(masked[:3]))) for p in range(3)]

    busy = {leaf for leaf, n in leaf_lines.items() if n >= 10}
    rare = Counter(w for *_, m in lines if (len(m), m[:3]) not in busy for w in set(ways(m)))
    nodes = busy | {leaf for leaf, n in rare.items() if n >= 10}
    leaf_of = {}
    for masked in holders:
        own = len(masked), masked[:3]
        leaf_of[masked] = own if own in busy else next((w for w in ways(masked) if w in nodes), None)
    support = Counter()
    for masked, docs in holders.items():
        for p, w in enumerate(masked):
            support[(leaf_of[masked], p, w)] += len(docs)
    forms = {}
    for masked in holders:
        leaf = leaf_of[masked]
        form = tuple(w if w != "<*>" and support[(leaf, p, w)] >= 10 else "<*>" for p, w in enumerate(masked))
        if leaf and 100 * sum(w != "<*>" for w in form) >= 60 * len(form):
            forms[masked] = leaf, form
    found = defaultdict(list)
    for i, d, k, masked in lines:
        if masked in forms:
            found[forms[masked]].append((d is None, d or 0, k, i))
    gone = defaultdict(set)
    passages = {id(p) for words, p in exact.items() if len(words) >= 50 and len({rows[i][1] for *_, i in p}) > 1}
    for places in [*found.values(), *exact.values()]:
        if len({rows[i] for *_, i in places}) >= 10 or id(places) in passages:
            first = min(places)[:3]
            for *place, i in places:
                if tuple(place) != first:
                    gone[i].add(place[2])
    out = []
    for i, (_, text) in enumerate(rows):
        parts = [] if text is None else text.split("\n")
        left = "\n".join(p for k, p in enumerate(parts) if k not in gone[i])
        out.append((None if text is None else left, len(parts), len(gone[i])))
    return out


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def close_groups(prints):
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    return {p: root(p) for p in prints}


def nearest_rates(tokens, p, shares, ridge=1e-6):
    """Rates nearest to one that leave the least squared gaps: the zero set is settled by trial, one document set at a time."""
    base = tokens @ p
    some = base > 0
    base, p = base[some], p[:, some]
    target, above = shares[some] * base, np.ones(len(tokens), bool)
    if not some.any():
        return np.ones(len(tokens))
    for _ in range(10_000):
        t = tokens * above
        curve = (p * t[:, None]).T @ p + ridge * np.diag(base)
        pull = np.linalg.solve(curve, p.T @ t - target)
        r = 1 - p @ pull
        if ((r > 0) == above).all():
            break
        above = r > 0
    else:
        raise AssertionError("not settled")
    return np.maximum(0, r)


def mixture(rows, labels, shares=(1.0, 0.25, 0.25)):
    """``rows`` of (doc_id, text), ``labels`` of (doc_id, quality, toxic): (n_tokens, parts, rate, copies) in order."""
    domain = {}
    for d, q, t in labels:
        k = 0 if q == 1 and t == 0 else 1 if q == 0 and t == 0 else 2 if t == 1 else None
        if d is not None and k is not None:
            domain[d] = min(k, domain.get(d, k))

    def featured(text):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r.,;:!?\"'()]+", (text or "").lower()) if w]
        n, distinct = len(words), list(dict.fromkeys(words))
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        more = [
            f"\n symbols {min(20, 10 * symbols // max(n, 1))}",
            f"\n distinct {10 * len(distinct) // max(n, 1)}",
            f"\n length {max(n.bit_length(), 1)}",
        ]
        return n, distinct + more

    docs = [featured(t) for _, t in rows]
    size, seen = [0, 0, 0], defaultdict(lambda: [0, 0, 0])
    for (d, _), (_, words) in zip(rows, docs):
        if d in domain:
            size[domain[d]] += 1
            for w in words:
                seen[w][domain[d]] += 1
    total = sum(size)
    prior = [math.log((s + 1) / (total + 3)) for s in size]
    weight = [{}, {}, {}]
    for k in (1, 2):
        a, b, found = size[k] + 1, total - size[k] + 1, []
        for w, row in seen.items():
            p, q, pool = (row[k] + 0.5) / a, (sum(row) - row[k] + 0.5) / b, (sum(row) + 1) / (total + 2)
            z = (p - q) / math.sqrt(pool * (1 - pool) * (1 / a + 1 / b))
            if row[k] >= 10 and z > 4 and p > 4 * q:
                found.append((-z, w.encode(), w, p, q))
        for _, _, w, p, q in sorted(found)[:64]:
            prior[k] += math.log((1 - p) / (1 - q))
            weight[k][w] = math.log(p / q) - math.log((1 - p) / (1 - q))
    parts = []
    for _, b in docs:
        s = [prior[k] + sum(weight[k].get(x, 0.0) for x in b) for k in range(3)]
        e = [math.exp(x - max(s)) for x in s]
        q = [math.floor(100 * x / sum(e)) for x in e]
        q[e.index(max(e))] += 100 - sum(q)
        parts.append(q)
    tokens, p = np.array([n for n, _ in docs], float), np.array(parts) / 100
    r = nearest_rates(tokens, p, np.array(shares))
    out = []
    for (d, _), (n, _), q, rate in zip(rows, docs, parts, r):
        luck = hash64("draw", *([] if d is None else [d])) % (1 << 20) / (1 << 20)
        out.append((n, q, float(rate), math.floor(rate) + (luck < rate - math.floor(rate))))
    return out


def digest(data):
    return hashlib.sha256(data).hexdigest()


def five_words(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar_firsts(rows):
    """doc_ids of the smallest of each group, over all pairs."""
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())
