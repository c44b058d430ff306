"""Brute force that the tests share."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near_groups(rows, threshold):
    """The smallest doc_id of each group of near duplicates."""
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set(), t))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, ta) in enumerate(sets):
        for j, (_, b, tb) in enumerate(sets[:i]):
            if ta == tb or (a and b and len(a & b) >= threshold * len(a | b)):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    return [min(g) for g in groups.values()]
