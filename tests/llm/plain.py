"""Plain versions of the operators on lists, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    own = words((text or "").translate(LOWER))
    return frozenset(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()


def similar(rows, percent=80):
    """{doc_id: (set size, component)} of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target} from {source: words}."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full) or 1
        got = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and got[s] > most * sizes[s]}
        if not over:
            return got
        full |= over


def seats(votes, n):
    """Highest quotients, one seat after the other."""
    won = Counter()
    for _ in range(n):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * won[k] + 1))
        won[best] += 1
    return {k: won[k] for k in votes}


def measures(text):
    own, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(k, k + 5))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(own), sum(map(len, own)), symbols, dup, len(covered))


def broken_rules(text):
    """The quality rules that a text breaks."""
    text = text or ""
    own, raw = words(text), text.encode()
    n, chars, symbols, dup, _ = measures(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    counts = Counter(raw)
    bits = -sum(c / len(raw) * math.log2(c / len(raw)) for c in counts.values())
    tests = {
        "symbols": 10 * symbols > 3 * n,
        "short words": chars < 2 * n,
        "long words": chars > 15 * n,
        "repeated lines": 100 * dup > 50 * len(lines),
        "bullets": len(lines) > 2 and 10 * sum(words(x)[0][0] in "-*•" for x in lines) > 9 * len(lines),
        "lines cut off": len(lines) > 2 and 10 * sum(words(x)[-1].endswith(("...", "…")) for x in lines) > 9 * len(lines),
        "few different words": 10 * len(set(own)) < n,
        "one kind of character": bits < 2,
        "compresses too well": 10 * len(zlib.compress(raw, 1)) < len(raw),
    }
    return {name for name, broken in tests.items() if broken}


def duplicates(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return groups


def shares(rows):
    """(host share, path share) of each (host, path, good), from all other rows; priors as strong as groups differ."""

    def grouped(key):
        sums = defaultdict(lambda: [0.0, 0])
        for row in rows:
            sums[key(row)][0] += row[2]
            sums[key(row)][1] += 1
        return sums

    def strength(sums, prior):
        chance = sum(prior(k) * (1 - prior(k)) for k in sums)
        seen = sum(n * (good / n - prior(k)) ** 2 for k, (good, n) in sums.items())
        scale = max(sum(n * prior(k) * (1 - prior(k)) for k, (_, n) in sums.items()), 1e-9)
        return min(10_000, max(2, 1 / max((seen - chance) / scale, 1e-4) - 1))

    hosts, paths = grouped(lambda row: row[0]), grouped(lambda row: row[:2])
    total, good = len(rows), sum(row[2] for row in rows)
    a = strength(hosts, lambda host: good / total)
    b = strength(paths, lambda path: (hosts[path[0]][0] + a * good / total) / (hosts[path[0]][1] + a))
    found = []
    for host, path, own in rows:
        above = (hosts[host][0] - own + a * (good - own) / (total - 1)) / (hosts[host][1] - 1 + a)
        found.append((above, (paths[host, path][0] - own + b * above) / (paths[host, path][1] - 1 + b)))
    return found
