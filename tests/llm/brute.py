"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile("[^ \t-\r]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def base_quality(text):
    ws, text = words(text), text or ""
    win = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n, cov, seen, dup = Counter(win), set(), set(), 0
    for i, v in enumerate(win):
        if n[v] > 1:
            cov |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cov)


def shingle_set(text, k):
    ws = words(text, True)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def components(rows, k, percent):
    """Component of each row: the least id of the rows that links connect it with."""
    sets = [shingle_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def within(a, b, tau):
    """Whether a and b are within tau edits: the table's rows, but for cells further than tau from the diagonal."""
    p = {j: j for j in range(min(len(b), tau) + 1)}
    for i, x in enumerate(a, 1):
        q = {}
        for j in range(max(0, i - tau), min(len(b), i + tau) + 1):
            q[j] = i if j == 0 else min(p.get(j, tau + 1) + 1, q.get(j - 1, tau + 1) + 1, p.get(j - 1, tau + 1) + (x != b[j - 1]))
        if not q or min(q.values()) > tau:
            return False
        p = q
    return p.get(len(b), tau + 1) <= tau


def dedup_lines(rows):
    """Edits allowed between two lines: none below 8 code points of the shorter one, one below 24, else two."""
    first = {}
    for d, t in rows:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if WORD.search(line):
                first[line] = min(first.get(line, (float("inf"), 0)), (d, i))

    def near(x, y):
        short = min(len(x), len(y))
        tau = 0 if short < 8 else 1 if short < 24 else 2
        return tau and abs(len(x) - len(y)) <= tau and within(x, y, tau)

    gone = {x for x in first if any(y != x and first[y] < first[x] and near(x, y) for y in first)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not WORD.search(x) or (first[x] == (d, i) and x not in gone)) for d, t in rows}


def base_lm(rows):
    tokens = [[*words(t, True), None] for _, t in rows]
    train = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    n = Counter(x for ts, ok in zip(tokens, train, strict=True) if ok for x in ts)
    total, v = sum(n.values()), len(n)
    return [(d, not ok, len(ts), sum(n[x] > 0 for x in ts), total, sum(np.log10((n[x] + 0.1) / (total + 0.1 * (v + 1))) for x in ts)) for (d, _), ts, ok in zip(rows, tokens, train, strict=True)]


def targets(sizes):
    src = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(src)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in fixed)
        mass = sum(w[s] for s in src if s not in fixed)
        t = {s: 2.0 * sizes[s] if s in fixed else rest * w[s] / mass for s in src}
        over = {s for s in src if s not in fixed and t[s] > 2 * sizes[s]}
        if not over:
            return t
        fixed |= over


def sainte_lague(votes, seats):
    q = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * q[i] + 1), -i))
        q[k] += 1
    return q


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(s)) % 10 == 0


def pii(text):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out
