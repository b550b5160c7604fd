"""Suffix sorting by grouping, without recursive renaming; linear but for the sorting of members that move to a new group.

Phase 1 groups suffixes by their Lyndon prefix: groups are taken in descending order, each suffix of a group finds its
previous smaller suffix, and the suffixes pointed to move to new groups right above their old ones, by how often they were
pointed to. Phase 2 reads the order off: going through the array, every suffix places its left neighbour and that
neighbour's chain of previous smaller suffixes at the front of their groups."""

from __future__ import annotations

from collections import Counter, defaultdict


def suffix_array(data: bytes) -> list[int]:
    """Starts of the suffixes of data in ascending order."""
    text = [b + 1 for b in data]
    text.append(0)
    n = len(text)
    firsts = sorted(set(text))
    number = {c: g for g, c in enumerate(firsts)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in firsts]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(firsts) - 1))
    above = [*range(1, len(firsts)), -1]
    passed = bytearray(n)
    smaller = [-1] * n
    g = len(firsts) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            passed[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and passed[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            by_count: dict[int, list[int]] = defaultdict(list)
            for j, c in hits.items():
                by_count[c].append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = defaultdict(list)
                for j in by_count[c]:
                    moved[group[j]].append(j)
                for old, js in moved.items():
                    new = len(members)
                    js.sort()
                    members.append(js)
                    for j in js:
                        group[j] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
        g = below[g]
    sizes, place, at = Counter(group), [0] * len(members), 0
    g = 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        place[g] = at
        at += sizes.get(g, 0)
        g = above[g]
    order = [-1] * n
    placed = bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    place[group[n - 1]] += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            h = group[s]
            order[place[h]] = s
            place[h] += 1
            placed[s] = 1
            s = smaller[s]
    return order[1:]
