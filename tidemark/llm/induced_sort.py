"""External induced sorting of suffixes with common-prefix values.

Suffixes are typed S or L (smaller or larger than the next one). The leftmost S suffixes
are sorted first: their substrings by an induction of their own, then, if some are
equal, as a reduced string, recursively. From them the L suffixes are induced in
ascending and the S suffixes in descending order: whoever is taken in order puts its
predecessor into the queue of the predecessor's first character. Each tuple carries its
common prefix with the one before it in its queue, 1 more than the least value seen
since that queue's last tuple.

Taken in order, tuples of one character arrive in order. So the priority queue is one
first-in-first-out queue for each character (`DiskQueue`, on disk beyond a budget), and
blocks of a queue are handled with numpy at once. A reduced string has too many
characters for that: one within the memory budget is sorted in memory by doubling, a
larger one by the same induction, tuple by tuple, over `DiskHeap`.

What grows with the string (types, starts, substring order, names, both passes' tuples, flags)
is an array or a queue of `Store`, on disk beyond the budget, and handled in blocks.

Only `cap` characters count: suffixes equal in as many are in any order, and common
prefixes stop there.
"""

from __future__ import annotations

import heapq
import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 15
#: What sorting a reduced string in memory takes for each of its characters, and substrings for each of them.
SORT_BYTES = 72
PART_BYTES = 128
#: Bits of a character by which substrings are split at once while they are over the budget.
DIGIT = 8
NONE = np.int32(1 << 30)


class Store:
    """Task-private files, where Spark's own spills go; made on the first use, deleted by close."""

    def __init__(self) -> None:
        self.folder: str | None = None
        self._n = itertools.count()

    def path(self) -> str:
        if self.folder is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=local)
        return os.path.join(self.folder, str(next(self._n)))

    def array(self, n: int, dtype, memory: int) -> np.ndarray:
        """An array in memory, or on disk if its bytes exceed the budget."""
        if n * np.dtype(dtype).itemsize <= memory:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


class DiskQueue:
    """First-in-first-out rows of two integers; those over `room` rows go to a file."""

    def __init__(self, store: Store, room: int, kind=np.int32) -> None:
        self.store, self.room = store, room
        self.kind = np.dtype(kind)
        self.blocks: list[np.ndarray] = []
        self.held = 0
        self.file = None
        self.name = ""
        self.read_at = self.written = 0

    def push(self, rows: np.ndarray) -> None:
        self.blocks.append(rows)
        self.held += len(rows)
        if self.held > self.room:
            if self.file is None:
                self.name = self.store.path()
                self.file = open(self.name, "w+b")
            self.file.seek(0, 2)
            for b in self.blocks:
                self.file.write(np.ascontiguousarray(b, self.kind).tobytes())
            self.written += self.held
            self.blocks, self.held = [], 0

    def pop(self) -> np.ndarray | None:
        """The next block, at most BLOCK rows; None if empty."""
        if self.read_at < self.written:
            row = 2 * self.kind.itemsize
            self.file.seek(self.read_at * row)
            n = min(BLOCK, self.written - self.read_at)
            rows = np.frombuffer(self.file.read(n * row), self.kind).reshape(-1, 2)
            self.read_at += n
            return rows
        if not self.held:
            return None
        rows = self.blocks[0] if len(self.blocks) == 1 else np.concatenate(self.blocks)  # many small pushes make one block
        self.blocks = [rows[BLOCK:]] if len(rows) > BLOCK else []
        self.held = max(0, len(rows) - BLOCK)
        return rows[:BLOCK]

    def drop(self) -> None:
        if self.file is not None:
            self.file.close()
            os.remove(self.name)
            self.file = None


class Spill:
    """Rows of `width` integers under small keys, read by key in either direction; those over `room` rows go to one file."""

    def __init__(self, store: Store, keys: int, room: int, width: int, kind=np.int64) -> None:
        self.store, self.room, self.width, self.kind = store, room, width, np.dtype(kind)
        self.live: dict[int, list[np.ndarray]] = {}
        self.parts: list[list[tuple[int, int]]] = [[] for _ in range(keys)]  # (offset, rows) in the file
        self.rows = [0] * keys
        self.held = 0
        self.file = None
        self.name = ""

    def append(self, key: int, rows: np.ndarray) -> None:
        self.live.setdefault(key, []).append(rows)
        self.rows[key] += len(rows)
        self.held += len(rows)
        if self.held > self.room:
            if self.file is None:
                self.name = self.store.path()
                self.file = open(self.name, "w+b")
            self.file.seek(0, 2)
            for k, blocks in self.live.items():
                all_ = np.concatenate(blocks)
                for a in range(0, len(all_), BLOCK):
                    part = np.ascontiguousarray(all_[a : a + BLOCK], self.kind)
                    self.parts[k].append((self.file.tell(), len(part)))
                    self.file.write(part.tobytes())
            self.live, self.held = {}, 0

    def _part(self, offset: int, rows: int) -> np.ndarray:
        self.file.seek(offset)
        return np.frombuffer(self.file.read(rows * self.width * self.kind.itemsize), self.kind).reshape(-1, self.width)

    def read(self, key: int, backward: bool = False) -> Iterator[np.ndarray]:
        """Its blocks, the first or the last first; rows in a block are always in the order they came."""
        parts, live = self.parts[key], self.live.get(key, [])
        if backward:
            yield from reversed(live)
            yield from (self._part(*x) for x in reversed(parts))
        else:
            yield from (self._part(*x) for x in parts)
            yield from live

    def forget(self, key: int) -> None:
        """A key that was read is not wanted again; the file goes with the last one."""
        self.held -= sum(map(len, self.live.pop(key, [])))
        self.parts[key], self.rows[key] = [], 0
        if self.file is not None and not any(self.rows):
            self.file.close()
            os.remove(self.name)
            self.file = None


class DiskHeap:
    """A priority queue of integer tuples (three values); sorted runs over `room` tuples go to files, RUNS of which are merged."""

    RUNS = 64

    def __init__(self, store: Store, room: int) -> None:
        self.store, self.room = store, room
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            self.heap.sort()
            keep, out = self.heap[: self.room // 4], self.heap[self.room // 4 :]
            self.heap = keep
            self._write(iter(out))
            if len(self.runs) >= self.RUNS:
                runs, self.runs = self.runs, []
                self._write(heapq.merge(*(itertools.chain([head], rows) for head, _, rows in runs)))

    def _write(self, items: Iterator[tuple]) -> None:
        name = self.store.path()
        with open(name, "wb") as f:
            while part := list(itertools.islice(items, 4096)):
                np.array(part, np.int64).tofile(f)
        self._next(self._rows(name))

    def _rows(self, name: str) -> Iterator[tuple]:
        with open(name, "rb") as f:
            while data := f.read(24 * max(4, self.room // self.RUNS)):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 3).tolist())
        os.remove(name)

    def _next(self, rows: Iterator[tuple]) -> None:
        head = next(rows, None)
        if head is not None:
            heapq.heappush(self.runs, (head, id(rows), rows))

    def peek(self) -> tuple | None:
        if self.heap and (not self.runs or self.heap[0] < self.runs[0][0]):
            return self.heap[0]
        return self.runs[0][0] if self.runs else None

    def pop(self) -> tuple:
        if self.heap and (not self.runs or self.heap[0] < self.runs[0][0]):
            return heapq.heappop(self.heap)
        head, _, rows = heapq.heappop(self.runs)
        self._next(rows)
        return head


def suffix_types(text: np.ndarray, store: Store, memory: int) -> np.ndarray:
    """S type of each suffix (the end counts as less than any character), block by block from the end."""
    n = len(text)
    is_s = store.array(n, bool, memory // 8)
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        b = min(a + BLOCK, n)
        t = np.asarray(text[a:b])
        change = np.flatnonzero(t[1:] != t[:-1]) + 1
        ends = np.append(change, len(t))
        rising = np.zeros(len(ends), bool)
        rising[:-1] = t[change] > t[change - 1]
        if b < n:
            rising[-1] = is_s[b] if text[b] == t[-1] else text[b] > t[-1]
        is_s[a:b] = np.repeat(rising, np.diff(ends, prepend=0))
    return is_s


def _run(text: np.ndarray, at: int, cap: int) -> int:
    """How often the character at a position repeats from there, up to cap."""
    part = np.asarray(text[at : at + cap])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _mark(flags: np.ndarray, rows: np.ndarray, before: int | None, length: int) -> None:
    """Flags the positions of a block whose common prefix with a neighbour is `length`; before: the position before the block."""
    pos, hit = rows[:, 0], rows[:, 1] >= length
    flags[pos[hit]] = True
    flags[pos[:-1][hit[1:]]] = True
    if hit[0] and before is not None:
        flags[before] = True


class _Carry:
    """The least common prefix seen since each queue's last tuple."""

    def __init__(self, size: int, cap: int) -> None:
        self.low = np.full(size, NONE, np.int32)
        self.has = np.zeros(size, bool)
        self.cap = cap

    def values(self, chars: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tuples from sources `at` of a block (common prefixes lcp with the source before): their order by character, and values."""
        order = np.argsort(chars, kind="stable")
        c, j = chars[order], at[order]
        prefix = np.minimum.accumulate(lcp)
        first = np.empty(len(c), bool)
        if len(c):
            first[0] = True
            first[1:] = c[1:] != c[:-1]
            out = np.empty(len(c), np.int32)
            f = np.flatnonzero(first)
            out[f] = np.where(self.has[c[f]], np.minimum(self.low[c[f]], prefix[j[f]]), -1)
            rest = np.flatnonzero(~first)
            out[rest] = _range_min(lcp, j[rest - 1] + 1, j[rest])
            last = np.append(f[1:] - 1, len(c) - 1)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], NONE)[j[last] + 1]
            self.low = np.minimum(self.low, prefix[-1])
            self.low[c[f]] = after
            self.has[c[f]] = True
            return order, np.minimum(out + 1, self.cap)
        self.low = np.minimum(self.low, prefix[-1])
        return order, np.empty(0, np.int32)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], inclusive, by a table of powers of two."""
    if not len(low):
        return np.empty(0, np.int32)
    span = high - low + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(low), np.int32)
    table, k = values, 0
    while True:
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(table[low[on]], table[high[on] - (1 << k) + 1])
        k += 1
        if k > level.max():
            return out
        table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])


def _induce(text, is_s, starts, start_lcp, flags, store: Store, memory: int, cap: int) -> None:
    """Flags by two passes over sorted leftmost S suffixes, the L suffixes of every character ascending, then the S suffixes descending.

    A block is flagged when it is taken; only the L tuples are kept (on disk beyond the budget), for the second pass.
    """
    sigma = int(max(np.max(text[a : a + BLOCK]) for a in range(0, len(text), BLOCK))) + 1
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    room = max(BLOCK, memory // 64 // max(1, min(sigma, 64)))
    sizes = np.zeros(sigma, np.int64)
    for a in range(0, len(starts), BLOCK):
        sizes += np.bincount(text[starts[a : a + BLOCK]], minlength=sigma)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    left = Spill(store, sigma, max(BLOCK, memory // 64), 2, kind)
    ends: dict[bool, dict[int, int]] = {False: {}, True: {}}  # the last position taken of each character

    def passes(down: bool) -> None:
        queues = [DiskQueue(store, room, kind) for _ in range(sigma)]
        carry = _Carry(sigma, cap)

        def scan(pos: np.ndarray, lcp: np.ndarray) -> None:
            p = pos[pos > 0] - 1
            at = np.flatnonzero(pos > 0)
            ok = is_s[p] if down else ~is_s[p]
            p, at = p[ok], at[ok]
            chars = text[p].astype(np.int64)
            order, values = carry.values(chars, at, lcp)
            p, chars = p[order], chars[order]
            cuts = np.flatnonzero(np.diff(chars, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(chars))):
                queues[chars[a]].push(np.stack([p[a:b], values[a:b]], 1).astype(kind))

        def meet(c: int, last: int | None, first: int) -> int:
            return 0 if last is None else min(_run(text, last, cap), _run(text, first, cap))

        if not down:  # the last suffix is L: the end of the text comes before everything
            queues[int(text[-1])].push(np.array([[len(text) - 1, 0]], kind))
            carry.has[int(text[-1])] = True
            carry.low[int(text[-1])] = 0
        for c in range(sigma - 1, -1, -1) if down else range(sigma):
            last = None
            while (rows := queues[c].pop()) is not None:
                rows = rows.copy()
                if last is None:
                    rows[0, 1] = 0
                _mark(flags, rows, last, cap)
                if not down:
                    left.append(c, rows)
                last = int(rows[-1, 0])
                scan(rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int32))
            queues[c].drop()
            if last is not None:
                ends[down][c] = last
            if down:  # then its L suffixes, the largest first
                follow = None
                for rows in left.read(c, backward=True):
                    pos = rows[::-1, 0].astype(np.int64)
                    lcp = np.empty(len(pos), np.int32)
                    lcp[1:] = rows[:0:-1, 1]
                    lcp[0] = follow if follow is not None else meet(c, last, int(pos[0]))
                    follow = rows[0, 1]
                    scan(pos, lcp)
                left.forget(c)
            else:  # then its leftmost S suffixes
                for a in range(bounds[c], bounds[c + 1], BLOCK):
                    pos = starts[a : min(a + BLOCK, bounds[c + 1])].astype(np.int64)
                    lcp = start_lcp[a : a + len(pos)].astype(np.int32)
                    if a == bounds[c]:
                        lcp[0] = meet(c, last, int(pos[0]))
                    scan(pos, lcp)

    passes(False)
    passes(True)
    for c in ends[False].keys() & ends[True].keys():
        a, b = ends[False][c], ends[True][c]
        if min(_run(text, a, cap), _run(text, b, cap)) >= cap:
            flags[a] = flags[b] = True


def _doubling(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes) of a string's suffixes by their first `limit` characters at least; in memory."""
    n = len(names)
    kind = np.int32 if n < 1 << 30 else np.int64
    levels = [(names + 1).astype(kind)]
    width = 1
    while width < limit and int(levels[-1].max()) < n:
        pairs = levels[-1].astype(np.int64) * (n + 2)
        if width < n:
            pairs[: n - width] += levels[-1][width:]
        _, rank = np.unique(pairs, return_inverse=True)
        levels.append((rank + 1).astype(kind))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[same] += 1 << k
        b[same] += 1 << k
        lcp[1:][same] += 1 << k
    return order, lcp


def _by_heap(names: np.ndarray, store: Store, memory: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes) of a reduced string that is over the budget: induction tuple by tuple over DiskHeap."""
    n = len(names)
    is_s = suffix_types(names, store, memory)
    starts, start_lcp = _sorted_starts(names, is_s, store, memory, cap)
    room = max(4, memory // 256)
    order, lcps = store.array(n, np.int64, memory // 8), store.array(n, np.int32, memory // 8)
    sigma = int(names.max()) + 1
    slots = store.array(sigma + 1, np.int64, memory // 8)
    for a in range(0, n, BLOCK):
        np.add.at(slots, names[a : a + BLOCK] + 1, 1)
    np.cumsum(slots, out=slots)
    fill, ends_l, last_at = (store.array(sigma, np.int64, memory // 8) for _ in range(3))
    both = lambda p, q: min(_run(names, int(p), cap), _run(names, int(q), cap))

    def passes(down: bool) -> None:
        heap, seq = DiskHeap(store, room), itertools.count()
        # the least value over the last so many tuples taken, by a stack of minimums
        taken: list[tuple[int, int]] = []  # (count, value), values increasing
        count = 0
        last_at[:] = -2

        def take(p: int, value: int) -> None:
            nonlocal count
            while taken and taken[-1][1] >= value:
                taken.pop()
            taken.append((count, value))
            count += 1
            q = p - 1
            if p and bool(is_s[q]) == down:
                c = int(names[q])
                if last_at[c] > -2:
                    i = _bisect(taken, int(last_at[c]) + 1)
                    v = min(taken[i][1] + 1, cap)
                else:
                    v = 0
                last_at[c] = count - 1
                heap.push((-c if down else c, next(seq), q * (cap + 1) + v))

        fill[:] = slots[1:] if down else slots[:-1]
        at_start = 0
        if not down:
            last_at[int(names[-1])] = -1
            heap.push((int(names[-1]), next(seq), (n - 1) * (cap + 1)))
        for c in range(sigma - 1, -1, -1) if down else range(sigma):
            last = None
            while (head := heap.peek()) is not None and head[0] == (-c if down else c):
                _, _, packed = heap.pop()
                p, v = divmod(packed, cap + 1)
                v = 0 if last is None else v
                if down:
                    fill[c] -= 1
                    order[fill[c]], lcps[fill[c]] = p, v
                else:
                    order[fill[c]], lcps[fill[c]] = p, v
                    fill[c] += 1
                last = p
                take(p, v)
            if down:
                end, before = ends_l[c], None
                for i in range(end - 1, slots[c] - 1, -1):
                    p = int(order[i])
                    v = before if before is not None else (0 if last is None else both(last, p))
                    before = int(lcps[i])
                    take(p, v)
            else:
                ends_l[c] = fill[c]
                first = True
                while at_start < len(starts) and names[starts[at_start]] == c:
                    p = int(starts[at_start])
                    v = int(start_lcp[at_start])
                    if first:
                        v = 0 if last is None else both(last, p)
                    first = False
                    take(p, v)
                    at_start += 1

    passes(False)
    passes(True)
    # S values are common prefixes with the next suffix: turn them into those with the one before
    out = store.array(n, np.int32, memory // 8)
    for c in range(sigma):
        a, m, b = slots[c], ends_l[c], slots[c + 1]
        out[a:m] = lcps[a:m]
        if m < b:
            out[m + 1 : b] = lcps[m : b - 1]
            out[m] = both(order[m - 1], order[m]) if m > a else 0
    return order, out


def _bisect(taken: list[tuple[int, int]], count: int) -> int:
    low, high = 0, len(taken) - 1
    while low < high:
        mid = (low + high) // 2
        if taken[mid][0] >= count:
            high = mid
        else:
            low = mid + 1
    return low


def _equal_length(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, up to limit."""
    n, out = len(text), np.zeros(len(a), np.int32)
    open_ = np.arange(len(a))
    k = 0
    while len(open_) and k < limit:
        x, y = a[open_] + k, b[open_] + k
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        open_ = open_[ok]
        out[open_] += 1
        k += 1
    return out


def _leftmost(is_s: np.ndarray, store: Store, memory: int) -> np.ndarray:
    """The leftmost S positions, ascending."""

    def found() -> Iterator[np.ndarray]:
        for a in range(1, len(is_s), BLOCK):
            b = min(a + BLOCK, len(is_s))
            yield np.flatnonzero(is_s[a:b] & ~is_s[a - 1 : b - 1]) + a

    starts, at = store.array(sum(map(len, found())), np.int64, memory // 8), 0
    for x in found():
        starts[at : at + len(x)] = x
        at += len(x)
    return starts


def _sorted_starts(text, is_s, store: Store, memory: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common prefixes) of the leftmost S suffixes in order."""
    starts = _leftmost(is_s, store, memory)
    m = len(starts)
    if not m:
        return starts, np.zeros(0, np.int32)
    chunk = max(BLOCK, memory // 256)
    order = _sort_substrings(text, starts, store, memory)
    names = store.array(m, np.int64, memory // 8)
    name = 0
    for i in range(1, m, chunk):
        ids = np.asarray(order[i - 1 : i + chunk])
        at, size = starts[ids], _lengths(text, starts, ids)
        same = (size[1:] == size[:-1]) & (ids[1:] < m - 1) & (ids[:-1] < m - 1)  # the last one ends with the text
        same[same] = _equal_length(text, at[:-1][same], at[1:][same], int(size.max())) >= size[:-1][same]
        names[ids[1:]] = name + np.cumsum(~same)
        name += int((~same).sum())
    if name + 1 == m:
        reduced, shared = order, store.array(m, np.int32, memory // 8)
    elif m * SORT_BYTES <= memory:
        reduced, shared = _doubling(np.asarray(names), cap)
    else:
        reduced, shared = _by_heap(names, store, memory, cap)
    # from names to characters: the equal substrings, then what the next two share
    out, lcp = store.array(m, np.int64, memory // 8), store.array(m, np.int32, memory // 8)
    out[0] = starts[reduced[0]]
    for i in range(1, m, chunk):
        ids = np.asarray(reduced[i - 1 : i + chunk], np.int64)
        x, y, k = ids[:-1], ids[1:], np.asarray(shared[i : i + chunk], np.int64)
        xe, ye = np.minimum(x + k, m - 1), np.minimum(y + k, m - 1)
        whole = np.minimum(starts[xe] - starts[x], cap)
        tail = _equal_length(text, starts[xe], starts[ye], cap)
        lcp[i : i + len(y)] = np.minimum(whole + tail, cap)
        out[i : i + len(y)] = starts[y]
    return out, lcp


def _lengths(text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Lengths of the substrings: up to the next leftmost S position, or the end."""
    last = len(starts) - 1
    return np.where(ids < last, starts[np.minimum(ids + 1, last)], len(text) - 1) - starts[ids] + 1


def _sort_substrings(text: np.ndarray, starts: np.ndarray, store: Store, memory: int) -> np.ndarray:
    """Order of the substrings. Those over the budget are split by their next digit into files, the rest is sorted in memory."""
    m, n = len(starts), len(text)
    order, done = store.array(m, np.int64, memory // 8), 0
    top = int(max(np.max(text[a : a + BLOCK]) for a in range(0, n, BLOCK))) + 2  # stands for the end of a substring
    digits = -(-top.bit_length() // DIGIT)
    whole = lambda: (np.arange(a, min(a + BLOCK, m)) for a in range(0, m, BLOCK))
    stack: list[tuple[Spill | None, int, int, int]] = [(None, 0, m, 0)]
    while stack:
        parts, key, count, k = stack.pop()
        blocks = whole() if parts is None else (rows[:, 0] for rows in parts.read(key))
        at, step = divmod(k, digits)
        if count == 1 or count * PART_BYTES <= memory:
            ids = np.concatenate(list(blocks))
            order[done : done + count] = ids[_sort_part(text, starts[ids], _lengths(text, starts, ids), ids == m - 1, at, top)]
            done += count
        else:
            split = Spill(store, 1 << DIGIT, max(BLOCK, memory // 64), 1)
            ended = False
            for ids in blocks:
                size = _lengths(text, starts, ids)
                if step == 0 and at and size[0] < at:  # they ended a character before, so they are equal
                    ended = True
                    order[done : done + len(ids)] = ids
                    done += len(ids)
                    continue
                v = np.where(ids == m - 1, 0, top)
                inside = at < size
                v[inside] = text[starts[ids[inside]] + at].astype(np.int64) + 1
                d = v >> DIGIT * (digits - 1 - step) & (1 << DIGIT) - 1
                by = np.argsort(d, kind="stable")
                cuts = np.flatnonzero(np.diff(d[by], prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(by))):
                    split.append(int(d[by[a]]), ids[by[a:b], None])
            if not ended:
                stack += [(split, d, c, k + 1) for d, c in reversed(list(enumerate(split.rows))) if c]
        if parts is not None:
            parts.forget(key)
    return order


def _sort_part(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, is_last: np.ndarray, k: int, top: int) -> np.ndarray:
    """Order of substrings that agree in k characters: by rounds of four characters, over those that are still tied.

    Where one substring begins another, one of the two is the last, which ends with the
    text: no other ends where a leftmost S suffix starts and goes on. It comes first.
    """
    n = len(text)
    base = top + 1
    per = 1
    while base ** (per + 1) < 1 << 40 and per < 4:
        per += 1
    group = np.zeros(len(starts), np.int64)
    order = np.arange(len(starts))
    tied = order
    while len(tied):
        key = np.zeros(len(tied), np.int64)
        for i in range(per):
            at = starts[tied] + k + i
            inside = (k + i < lengths[tied]) & (at < n)
            v = np.where(is_last[tied], 0, base - 1)
            v[inside] = text[at[inside]].astype(np.int64) + 1
            key = key * base + v
        by = np.lexsort((key, group[tied]))
        g, q, members = group[tied][by], key[by], tied[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (q[1:] != q[:-1])
        first = np.ones(len(by), bool)
        first[1:] = g[1:] != g[:-1]
        # a group's number is its first rank: ties keep it, the others move on by how many come before
        index = np.arange(len(by))
        begin = index[new][np.cumsum(new) - 1]
        origin = index[first][np.cumsum(first) - 1]
        group[members] = g + (begin - origin)
        sizes = np.diff(np.append(np.flatnonzero(new), len(by)))
        k += per
        goes_on = np.maximum.reduceat(lengths[members], np.flatnonzero(new)) > k  # one that has ended comes before those that go on
        tied = members[np.repeat((sizes > 1) & goes_on, sizes)]
    # the last substring ends with the text, so it comes before its equals
    return np.lexsort((~is_last, group))


def repeated_positions(text: np.ndarray, length: int, memory: int = 64 << 20) -> np.ndarray:
    """Flags of the positions whose next `length` characters start somewhere else, too.

    text: small integers; a separator may occur often, as a string that holds one can be
    flagged like any other: callers look only at positions whose string holds none.
    """
    n = len(text)
    store = Store()
    try:
        flags = store.array(n, bool, memory // 8)
        if n < 2:
            return flags
        is_s = suffix_types(text, store, memory)
        starts, start_lcp = _sorted_starts(text, is_s, store, memory, length)
        _induce(text, is_s, starts, start_lcp, flags, store, memory, length)
        return flags  # a mapped file stays readable after close
    finally:
        store.close()
