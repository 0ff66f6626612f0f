"""Linear suffix sorting by grouping, without recursion or renaming."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """The starts of all suffixes of text in order; a suffix that ends first is smaller.

    First, suffixes are grouped by their Lyndon prefix, the part before the next smaller suffix. Groups start as those of equal
    first bytes and are processed in descending order. Every member points to the closest suffix before it that is in a smaller
    group; what is pointed at, put in front of such a member, has a longer Lyndon prefix, so it leaves its group for a new one just
    behind, by how many members point at it. Second, suffixes are taken in ascending order. Those whose next smaller suffix is
    the one just taken are found along the pointers, and each takes the first free place of its group.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    for at, i in enumerate(order):
        place[i] = at
    end_of = [0] * (n + 1)
    start_of, start = [0] * 256, 0
    for byte in sorted(set(text)):
        start_of[byte] = start
        end_of[start] = start + text.count(byte)
        start = end_of[start]
    group = [start_of[byte] for byte in text]  # a group is named by the place where it starts
    group.append(-1)  # the group of place -1, less than all others
    before = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while group[p] >= start:
                p = before[p]
            before[i] = p
            levels = [(p,)] if p >= 0 else ()
        elif end - start == 2:
            i, j = order[start:end]
            if i > j:
                i, j = j, i
            p = i - 1
            while group[p] >= start:
                p = before[p]
            before[i] = p
            q = j - 1
            while group[q] >= start:
                q = before[q]
            before[j] = q
            if p >= 0 and q >= 0 and p != q:
                g = group[p]
                levels = () if g == group[q] and end_of[g] - g == 2 else ((p, q),)  # if they are all of their group, they stay as they are
            else:
                levels = ((max(p, q),),) if p >= 0 or q >= 0 else ()
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[start:end]):
                p = i - 1
                while group[p] >= start:
                    p = before[p]
                before[i] = p
                pointed[p] = pointed.get(p, 0) + 1
            pointed.pop(-1, None)
            most = max(pointed.values(), default=0)
            levels = [pointed] if most == 1 else [[p for p, k in pointed.items() if k == level] for level in range(most, 0, -1)]
        for level in levels:
            if len(level) == 1:
                (p,) = level
                g = group[p]
                last = end_of[g] - 1
                if last > g:  # else p is all of its group, and stays as it is
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    group[p] = last
                    end_of[last], end_of[g] = last + 1, last
                continue
            groups = {group[p] for p in level}
            if len(groups) == 1:
                (g,) = groups
                last = end_of[g] - len(level)
                if last > g:
                    for at, p in enumerate(level, last):
                        other, old = order[at], place[p]
                        order[old], place[other] = other, old
                        order[at], place[p] = p, at
                        group[p] = last
                    end_of[last] = end_of[g]
                    end_of[g] = last
                continue
            fresh: dict[int, int] = {}  # old group to the end of what stays in it
            moved = []
            for p in level:
                g = group[p]
                last = fresh.get(g, end_of[g]) - 1
                fresh[g] = last
                other, at = order[last], place[p]
                if other != p:
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                moved.append((p, g))
            for p, g in moved:
                group[p] = fresh[g]
            for g, last in fresh.items():
                if last > g:  # else all of it has moved, and it stays as it is
                    end_of[last] = end_of[g]
                    end_of[g] = last
        end = start
    out, free, placed = [-1] * n, list(range(n + 1)), bytearray(n + 1)
    placed[n] = 1  # stands for place -1
    j = n - 1
    for r in range(n + 1):
        while not placed[j]:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            placed[j] = 1
            j = before[j]
        if r < n:
            j = out[r] - 1
    return out
