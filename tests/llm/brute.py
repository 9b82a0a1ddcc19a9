"""Plain row-at-a-time versions of what the operators compute."""

import re
from collections import defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def groups(nodes, links):
    """The smallest node that links lead to, of every node."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in parent}


def jaccard(rows):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    pairs = {(a, b) for found in index.values() for a in found for b in found if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = groups(sets, links)
    return {i: (len(s), part[i]) for i, s in sets.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
