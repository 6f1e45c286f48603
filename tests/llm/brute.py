"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(_FOLD))


def spaced(text):
    return words(text, r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = spaced(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(texts: dict, size: int, percent: int):
    """{id: (set size, smallest linked id)}"""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    holders, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            for j in holders[g]:
                both[j, i] += 1
            holders[g].append(i)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def contamination(text, items: dict, span: int = 10):
    """(words, words hit, sorted ids of the items met)"""
    w, hit, met = words(text), set(), set()
    for item, t in items.items():
        iw = words(t)
        n = min(span, len(iw))
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                met.add(str(item))
    return len(w), len(hit), sorted(met)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private_spans(text):
    """Base spans as kind:start:end, by kind, then start."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def deduplicated_lines(texts: dict, min_words: int = 40):
    """{id: text} without later copies of runs that hold ``min_words`` words, and the lines that went."""
    first, gone = {}, defaultdict(set)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        held = [len(x.split()) for x in lines]
        windows = set()
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if sum(held[a:b + 1]) >= min_words]
            starts = [b for b in range(a + 1) if sum(held[b:a + 1]) >= min_words]
            windows |= {(a, ends[0] + 1)} if ends else set()
            windows |= {(starts[-1], a + 1)} if starts else set()
        for a, b in sorted(windows):
            j, c = first.setdefault(tuple(lines[a:b]), (i, a))
            if (j, c) != (i, a):
                gone[i].update(range(max(a, c + b - a) if i == j else a, b))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}, gone


def base_labels(text):
    """(words, [(first word, label)]) of the base phrases."""
    w, out = words(text), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(out)
