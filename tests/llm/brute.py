"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

LOW = {k: k + 32 for k in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, window=13, share=20):
    found = defaultdict(set)
    for i, text in items:
        words = WORD.findall((text or "").translate(LOW))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            found[tuple(words[k:k + n])].add(i)
    sizes = {len(w) for w in found}
    out = []
    for i, text in docs:
        words = WORD.findall((text or "").translate(LOW))
        hit, some = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if got := found.get(tuple(words[k:k + n])):
                    hit.update(range(k, k + n))
                    some |= got
        digest = hashlib.sha256(",".join(sorted(map(str, some))).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(some), digest, bool(hit) and share * len(hit) >= len(words)))
    return out


def jaccard_components(docs, size=4, percent=85):
    sets = {}
    for i, text in docs:
        words = TOKEN.findall((text or "").translate(LOW))
        sets[i] = frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    shared = Counter((b, a) for some in by_shingle.values() for k, a in enumerate(some) for b in some[:k])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(i, len(sets[i]), root(i)) for i in sets]


M = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def word_hash(word):
    total, power = 0, 1
    for c in word.encode():
        total, power = total + mixed(c) * power, power * 0xD6E8FEB86659FD93 & M
    return mixed(total + len(word.encode()) & M)


def line_chunks(text, wrap=4):
    """[(first character, stop, lines, words, chunk, starts a source line, ends one)]"""
    found = list(TOKEN.finditer(text))
    words, name = [m[0] for m in found], [word_hash(m[0]) for m in found]
    n = len(words)
    full = [bool(re.search(r"[.!?][\"')\]]?$", w)) for w in words]
    capital = [bool(re.match(r"(?:[A-Z](?:[a-z]|[^\x00-\x7f])|[À-Þ]|[А-Я])", w)) for w in words]
    closes = [k == n - 1 or "\n" in text[found[k].end():found[k + 1].start()] for k in range(n)]
    hard = [closes[k] or full[k] and (not full[k + 1] or name[k] % wrap == 0) or capital[k + 1] for k in range(n)]
    out, k = [], 0
    while k < n:
        to = next(j for j in range(k, n) if hard[j])
        lines, line = [], []
        for j in range(k, to + 1):
            line.append(j)
            if j == to or name[j] % wrap == 0:
                lines.append(line)
                line = []
        hashes = [mixed(sum(mixed(name[j] + 7 & M) * (name[j] | 1) for j in x) & M) for x in lines]
        rolling = [mixed(h * 0x9E3779B97F4A7C15 + (hashes[i - 1] if i else 0) & M) for i, h in enumerate(hashes)]
        part = []
        for i, x in enumerate(lines):
            part.append(x)
            if i == len(lines) - 1 or 0 < i < len(lines) - 2 and rolling[i] < rolling[i - 1] and rolling[i] < rolling[i + 1]:
                a, b = part[0][0], part[-1][-1]
                stop = found[b + 1].start() if b + 1 < n else len(text)
                out.append((found[a].start(), stop, len(part), b - a + 1, text[found[a].start():found[b].end()], a == 0 or closes[a - 1], closes[b]))
                part = []
        k = to + 1
    return out


def dedup_lines(rows, least=8):
    """Texts of rows (id, text) without their repeated chunks; rows are in order of id, and ids differ."""
    cut = {i: line_chunks(t or "") for i, t in rows}
    counts = Counter(c[4] for some in cut.values() for c in some if c[2] > 1)
    candidates = Counter()
    chosen = {}
    for i, some in cut.items():
        hit = [c[2] > 1 and counts[c[4]] > 1 for c in some]
        chosen[i] = [h or c[2] == 1 and any(hit[j] for j in (k - 1, k + 1) if 0 <= j < len(some)) for k, (c, h) in enumerate(zip(some, hit))]
        candidates.update(c[4] for c, x in zip(some, chosen[i]) if x)
    seen, out = set(), {}
    for i, text in rows:
        gone, runs = [], []
        for k, (c, x) in enumerate(zip(cut[i], chosen[i])):
            if x and c[4] in seen:
                if gone and gone[-1] == k - 1:
                    runs[-1].append(c)
                else:
                    runs.append([c])
                gone.append(k)
            elif x:
                seen.add(c[4])
        kept, at = [], 0
        for run in runs:
            if any(c[2] > 1 for c in run) and (run[0][5] and run[-1][6] or sum(c[3] for c in run) >= least):
                kept.append(text[at:run[0][0]])
                at = run[-1][1]
        out[i] = None if text is None else "".join([*kept, text[at:]])
    return out


def kneser_ney(rows, discount=0.75, once=1.0):
    """The mean log ratio of a text, toxic less ordinary, by bigram models of rows (text, class) with shared continuations."""
    pairs = (Counter(), Counter())
    for text, c in rows:
        words = WORD.findall(text.translate(LOW))
        pairs[c].update(zip([None, *words], words))
    lefts = Counter(w for _, w in pairs[0] | pairs[1])
    alone = [Counter() for _ in pairs]
    for c in (0, 1):
        for (_, w), n in pairs[c].items():
            alone[c][w] += n

    def rest(c):
        return discount * len(alone[c]) / sum(alone[c].values())

    def word(c, w):
        if w not in lefts:
            return rest(c)
        return max(alone[c][w] - discount, 0) / sum(alone[c].values()) + rest(c) * lefts[w] / sum(lefts.values())

    followers = [defaultdict(list) for _ in pairs]
    for c in (0, 1):
        for (u, w), n in pairs[c].items():
            if u is not None:
                followers[c][u].append(n)

    def taken(n):
        return once if n == 1 else discount

    def probability(c, u, w):
        some = followers[c].get(u)
        if u is None or not some:
            return word(c, w)
        n = pairs[c][u, w]
        return (max(n - taken(n), 0) + sum(map(taken, some)) * word(c, w)) / sum(some)

    def ratio(text):
        words = WORD.findall(text.translate(LOW))
        return sum(math.log(probability(1, u, w) / probability(0, u, w)) for u, w in zip([None, *words], words)) / len(words)

    return ratio
