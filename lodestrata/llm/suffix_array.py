"""Suffix arrays in linear time by grouping suffixes under their Lyndon prefixes."""

from __future__ import annotations


def suffix_array(text) -> list[int]:
    """Starts of the suffixes of a sequence of small integers, in ascending order.

    The longest Lyndon prefix of a suffix ends where the next smaller suffix
    starts, and suffixes with a smaller such prefix are smaller. First the
    suffixes are grouped by it, from the largest group down. All members of
    the largest open group are known to have their whole Lyndon prefix; each
    of them, or a run of them side by side, lengthens the prefix of the
    nearest suffix on the left whose group is smaller, which pointers to the
    previous smaller suffix find without scanning. What is lengthened moves to
    a new group just above its old one, the more repeats the higher. Then the
    order inside the groups follows in one pass over the array itself: equal
    prefixes are ordered as the suffixes behind them are, and those, being
    smaller, have been emitted before.
    """
    text = list(text)
    n = len(text)
    if not n:
        return []
    size = [1] * n  # of the Lyndon prefix as far as known
    group = [0] * n
    members: list[list[int]] = []
    below: list[int] = []  # the next smaller group, -1 at the end
    above: list[int] = []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[c]:
            group[i] = g
    done = bytearray(n)
    smaller = [-1] * n
    run = [0] * (n + 1)
    ordered: list[list[int]] = []  # groups from the largest down
    top = len(members) - 1
    while top >= 0:
        held = [i for i in members[top] if group[i] == top]
        if held:
            step = size[held[0]]
            ordered.append(held)
            for i in held:
                done[i] = 1
            moves: list[tuple[int, int]] = []
            if len(held) == 1:
                i = held[0]
                p = i - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    moves.append((p, 1))
            else:
                held.sort()
                for i in reversed(held):
                    after = i + step
                    run[i] = run[after] + 1 if after < n and group[after] == top else 1
                for i in held:
                    p = i - 1
                    while p >= 0 and done[p] and group[p] != top:
                        p = smaller[p]
                    if p >= 0 and group[p] == top:  # the same prefix again; its first one counts the run
                        smaller[i] = smaller[p]
                    else:
                        smaller[i] = p
                        if p >= 0:
                            moves.append((p, run[i]))
            if len(moves) > 1:
                moves.sort(key=lambda m: m[1], reverse=True)  # so that each new group of one old group goes below the last
            fresh: dict[tuple[int, int], int] = {}
            for p, times in moves:
                old = group[p]
                at = fresh.get((old, times))
                if at is None:
                    at = fresh[old, times] = len(members)
                    members.append([p])
                    over = above[old]
                    above.append(over)
                    below.append(old)
                    below[over] = above[old] = at
                else:
                    members[at].append(p)
                group[p] = at
                size[p] += times * step
        top = below[top]
    # Slots of the groups, and the suffixes whose Lyndon prefix each suffix follows.
    slot, used = [0] * len(members), 0
    for held in reversed(ordered):
        slot[group[held[0]]] = used
        used += len(held)
    first, other = [-1] * (n + 1), [-1] * n
    for i in range(n):
        end = i + size[i]
        other[i] = first[end]
        first[end] = i
    out = [0] * n
    i = first[n]
    while i >= 0:
        g = group[i]
        out[slot[g]] = i
        slot[g] += 1
        i = other[i]
    for k in range(n):
        i = first[out[k]]
        while i >= 0:
            g = group[i]
            out[slot[g]] = i
            slot[g] += 1
            i = other[i]
    return out
