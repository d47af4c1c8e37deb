"""Plain versions of the operators, for small tables only."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def rule_counts(text):
    w = words(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)} if len(w) < 2000 else set()
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_words(text):
    return TEST_WORD.findall((text or "").translate(LOWER))


def contamination(rows, items):
    out = {}
    for d, t in rows:
        w, hit, found = test_words(t), set(), set()
        for item, x in items:
            v = test_words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for i in range(len(w) - n + 1):
                    if w[i] == v[s] and w[i:i + n] == v[s:s + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def repeats(rows):
    first, out = {}, {}
    for d, t in sorted(dict(rows).items()):
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i:i + 50]), d) < d:
                keep[i:i + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out[d] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_spans(text):
    t = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())[::-1]
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]
