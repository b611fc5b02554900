"""Bin completion on a histogram of lengths (at most ``capacity`` counts, whatever the corpus).

The bin of the largest remaining length is completed by an undominated filling;
the branch and bound tries fillings in order of their waste, prunes by a lower
bound on bins (total length and the pairing bound of large items) against the
incumbent, and starts from best-fit decreasing as the incumbent.  A filling is
applied as often as the counts allow first, so a plan has a few patterns for each
length and not one entry a bin; fewer times, and more fillings a bin, are tried
where nodes are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # ((length, how many), ...), largest first
Plan = list[tuple[Pattern, int]]  # and how many bins are filled like it
#: Steps of a search for fillings that count as a node.
STEPS = 500


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of Martello and Toth's bounds over all thresholds."""
    sizes = np.arange(len(counts))
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    k = np.arange(half + 1)
    alone = n[-1] - n[capacity - k]  # longer than capacity - k: nothing of k or more fits beside them
    large, large_sum = n[capacity - k] - n[half], total[capacity - k] - total[half]
    small_sum = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small_sum - (large * capacity - large_sum)) // capacity))
    return int(max((alone + large + more).max(), -(-total[-1] // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, all items of a length at once."""
    rest: dict[int, Counter] = {}  # free space: patterns
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            free = min((f for f in rest if f >= size), default=None)
            if free is None:
                per = min(capacity // size, left)
                made = left // per
                rest.setdefault(capacity - per * size, Counter())[((size, per),)] += made
                left -= made * per
                continue
            pattern, n = next(iter(rest[free].items()))
            per = min(free // size, left)
            made = min(n, left // per)
            rest[free][pattern] -= made
            if not rest[free][pattern]:
                del rest[free][pattern]
            if not rest[free]:
                del rest[free]
            rest.setdefault(free - per * size, Counter())[(*pattern, (size, per))] += made
            left -= made * per
    return [(p, n) for c in rest.values() for p, n in c.items()]


def _reach(counts: np.ndarray, room: int) -> list[int]:
    """reach[s]: bit set of the sums up to ``room`` that lengths of at most s can make."""
    mask, bits, out = (1 << room + 1) - 1, 1, [1] * (room + 1)
    for size, n in enumerate(counts[1:room + 1].tolist(), 1):
        left, step = n and min(n, room // size), 1
        while left > 0:  # as many as there are, by powers of two
            take = min(step, left)
            bits |= bits << size * take & mask
            left, step = left - take, 2 * step
        out[size] = bits
    return out


def fillings(counts: np.ndarray, room: int) -> Iterator[Pattern | None]:
    """Every undominated filling of ``room``, least waste first, large items first; None after each level of waste and each ``STEPS`` steps."""
    if room <= 0 or not counts[1:room + 1].any():
        yield ()
        return
    if counts[room]:  # one length without waste dominates every other filling
        yield ((room, 1),)
        return
    there = counts > 0
    for a in np.flatnonzero(there[1:room] & there[room - 1:0:-1])[::-1] + 1:  # two without waste: only one could dominate them
        b = room - int(a)
        if a > b or a == b and counts[a] > 1:
            yield ((int(a), 1), (b, 1)) if a > b else ((b, 2),)
    sizes = np.arange(room + 1)
    spare = np.zeros(room + 1, bool)  # lengths of which no filling can use up all
    spare[1:] = counts[1:room + 1] > room // sizes[1:]
    upto = np.concatenate([[0], np.cumsum(spare)])  # of those, how many are shorter than x
    had, any_reach = counts[:room + 1] * sizes, _reach(counts, room)[room]
    for waste in range(room):
        if had[:waste + 1].sum() > room - waste:  # what fits beside cannot all be in it, with more waste neither
            return
        of = counts[:room + 1].copy()  # without the lengths that a longer spare one replaces
        of[upto[np.minimum(sizes + waste, room) + 1] > upto[sizes + 1]] = 0
        if not of.any():
            return
        if any_reach >> room - waste & 1:
            yield from _exactly(counts, of, room, waste, upto)
            yield None


def _exactly(counts: np.ndarray, of: np.ndarray, room: int, waste: int, upto: np.ndarray) -> Iterator[Pattern | None]:
    """The undominated fillings that waste just so much, of the lengths counted in ``of``; pairs without waste are left out."""
    full, steps = room - waste, 0
    reach = _reach(of, full)
    if not reach[full] >> full & 1:
        return
    levels = [(full, (), iter(range(full, 0, -1)))]  # still free, chosen, lengths to try next
    while levels:
        left, chosen, sizes = levels[-1]
        size = next(sizes, 0)
        if not size:
            levels.pop()
            continue
        steps += 1
        if not steps % STEPS:
            yield None
        if of[size] <= chosen.count(size) or not reach[size] >> left - size & 1:
            continue
        if any(upto[min(c + size + waste, room) + 1] > upto[c + size] for c in {*chosen}):  # a spare length replaces the two
            continue
        items = (*chosen, size)
        if left > size:
            levels.append((left - size, items, iter(range(min(size, left - size), 0, -1))))
        elif (len(items) != 2 or waste) and not _dominated(items, counts, waste):
            yield tuple(sorted(Counter(items).items(), reverse=True))


def _dominated(items: tuple[int, ...], counts: np.ndarray, waste: int) -> bool:
    """An unused length fits beside, or a larger one could stand for one item, or for two, within the waste."""
    used = Counter(items)
    if any(counts[x] > used[x] for x in range(1, min(waste, len(counts) - 1) + 1)):
        return True
    free = [s for s in {*used} if waste and any(counts[x] > used[x] for x in range(s + 1, min(s + waste, len(counts) - 1) + 1))]
    if free:
        return True
    pairs = {a + b + w for i, a in enumerate(items[:40]) for b in items[i + 1:40] for w in range(waste + 1)}
    return any(x < len(counts) and counts[x] > used[x] for x in pairs)


def complete(counts: np.ndarray, capacity: int, branches: int = 3, nodes: int = 6000) -> Plan:
    """The best plan found: optimal if it meets the lower bound or the search ended, else the best after ``nodes`` nodes.

    A first search takes ``branches`` fillings a bin of the least waste that has any,
    each as often as the counts allow; the next takes them of every waste, and each
    one after it three times as many and each filling fewer times too, until one ends
    that left out nothing.  Each search has half of the nodes that are left.
    """
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    size_of = lambda plan: sum(n for _, n in plan)
    fewest = size_of(best)
    if not counts.any() or fewest == bound:
        return best
    cut = False

    def branch(left: np.ndarray, bins: int, path: tuple | None, wide: int, search: int) -> Iterator[tuple | None]:
        nonlocal cut
        top, given = int(np.flatnonzero(left)[-1]), 0
        rest = left.copy()
        rest[top] -= 1
        for filling in fillings(rest, capacity - top):
            if filling is None and (search or not given):
                yield None
                continue
            if filling is None or given == wide:
                cut = True
                return
            given += 1
            pattern = Counter(dict(filling))
            pattern[top] += 1
            times = min(int(left[s]) // k for s, k in pattern.items())
            cut |= times > 1 and search < 2
            while times:
                after = left.copy()
                for s, k in pattern.items():
                    after[s] -= times * k
                yield after, bins + times, (path, (tuple(sorted(pattern.items(), reverse=True)), times))
                times = times // 2 if search > 1 else 0

    for search in count():
        cut, some = False, max(nodes // 2, 1)
        wide, nodes = branches * 3 ** max(search - 1, 0), nodes - some
        stack = [branch(counts, 0, None, wide, search)]  # each level's fillings still to try; paths are linked plans
        while stack and fewest > bound and some > 0:
            some -= 1
            node = next(stack[-1], ())
            if node is None:
                continue
            if not node:
                stack.pop()
                continue
            left, bins, path = node
            if left.any():
                if bins + lower_bound(left, capacity) < fewest:
                    stack.append(branch(left, bins, path, wide, search))
            elif bins < fewest:
                best, fewest = [], bins
                while path:
                    best.append(path[1])
                    path = path[0]
        nodes += some
        if fewest == bound or nodes <= 0 or not (stack or cut):
            break
    return best
