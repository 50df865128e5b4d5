"""Suffix sorting by grouping: Lyndon-prefix groups first, each group's order after.

Suffixes start in groups by their first symbol. Groups are processed in descending order. A processed suffix points to the
nearest suffix on its left that lies in a lower group (found over the pointers of processed ones); the suffixes that are
pointed to by a group, k times each, extend their prefix by k copies of that group's prefix, and leave their group for new
ones just above it, in ascending k. In the end two suffixes share a group exactly if they share their longest Lyndon prefix.
The second pass goes through the order from the least suffix on: each suffix that is settled settles the places, in their
own groups, of those whose Lyndon prefix ends where it starts. Nothing is renamed or sorted again recursively; both passes
take time linear in the text but for the sort of the alphabet.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[list[int]]]:
    """(group of every suffix, members of every group in descending order of groups) by longest Lyndon prefix."""
    n = len(text)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    order = sorted(members)
    groups = [members[c] for c in order]
    size = [len(g) for g in groups]
    lower = list(range(-1, len(groups) - 1))  # the group below each; new groups are put in between
    above = [*range(1, len(groups)), -1]
    at = [0] * n
    for g, m in enumerate(groups):
        for i in m:
            at[i] = g
    left = [-1] * n
    done = bytearray(n)
    final: list[list[int]] = []
    g = len(groups) - 1
    while g >= 0:
        mine = [i for i in groups[g] if at[i] == g]
        groups[g] = mine
        final.append(mine)
        parents: list[int] = []
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = left[j]
            left[i] = j
            done[i] = 1
            if j >= 0:
                parents.append(j)
        if parents:
            if len(parents) == 1:
                h = at[parents[0]]
                moves = {h: {1: parents}} if size[h] > 1 else {}
            else:
                times: dict[int, int] = {}
                for p in parents:
                    times[p] = times.get(p, 0) + 1
                moves = {}
                for p in sorted(times):
                    moves.setdefault(at[p], {}).setdefault(times[p], []).append(p)
            for h, by in moves.items():
                if len(by) == 1 and len(next(iter(by.values()))) == size[h]:
                    continue  # the whole group extends its prefix alike
                below = h
                for k in sorted(by):
                    new, moved = len(groups), by[k]
                    groups.append(moved)
                    size.append(len(moved))
                    size[h] -= len(moved)
                    up = above[below]
                    lower.append(below)
                    above.append(up)
                    above[below] = new
                    if up >= 0:
                        lower[up] = new
                    for p in moved:
                        at[p] = new
                    below = new
        g = lower[g]
    return at, final


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a list of integers in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    at, final = lyndon_groups(text)
    rank = [0] * n
    slot: list[int] = []
    place = 0
    for r, mine in enumerate(m for m in reversed(final) if m):
        slot.append(place)
        place += len(mine)
        for i in mine:
            rank[i] = r
    # Lyndon prefixes end at the next suffix of the same or a lower group; link suffixes by that end.
    first, following = [-1] * (n + 1), [-1] * n
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        end = stack[-1] if stack else n
        following[i] = first[end]
        first[end] = i
        stack.append(i)
    out = [0] * n
    here = n
    for q in range(-1, n):
        if q >= 0:
            here = out[q]
        i = first[here]
        while i >= 0:
            r = rank[i]
            out[slot[r]] = i
            slot[r] += 1
            i = following[i]
    return out
