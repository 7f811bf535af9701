"""External induced sorting of suffixes, with common-prefix lengths.

The order of the suffixes at S* positions (those smaller than both neighbours) is found by
recursion on the string of their names; all others follow by induction: reading the suffixes in
order, each one decides where the suffix one place before it goes. What is induced waits in a
priority queue by (first symbol, rank of its cause) that carries (position, common prefix with
the entry before it); as causes come in rank order, the queue is a run of appended blocks for
each symbol, held in memory up to a quarter of ``memory`` entries (four queues live at once) and on disk beyond that. Common prefixes are
induced too: one more than the least between two causes.

Recursion stays on disk until the string of names has at most ``memory`` symbols, which is then
sorted by prefix doubling. Lengths are cut at ``depth``: suffixes that agree for so long are
neighbours in an order that is not further defined.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

CHUNK = 1 << 20


class SymbolQueue:
    """Disk-backed monotone priority queue: entries of one symbol come out as they were added."""

    KIND = np.dtype([("pos", "<i8"), ("lcp", "<i4")])
    FILES = 256

    def __init__(self, folder: str, symbols: int, memory: int) -> None:
        self.folder = tempfile.mkdtemp(dir=folder)
        self.memory, self.held = memory, 0
        self.width = -(-symbols // self.FILES)
        self.blocks: dict[int, list[np.ndarray]] = {}
        self.on_disk: set[int] = set()

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), self.KIND)
        block["pos"], block["lcp"] = pos, lcp
        self.blocks.setdefault(symbol, []).append(block)
        self.held += len(block)
        if self.held > self.memory:
            self._spill()

    def _name(self, group: int) -> str:
        return os.path.join(self.folder, str(group))

    def _spill(self) -> None:
        for symbol, blocks in self.blocks.items():
            group = symbol // self.width
            with open(self._name(group), "ab") as out:
                for b in blocks:
                    out.write(np.array([symbol, len(b)], "<i8").tobytes() + b.tobytes())
            self.on_disk.add(group)
        self.blocks, self.held = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of the symbol so far."""
        group = symbol // self.width
        if group in self.on_disk:
            self._load(group)
        blocks = self.blocks.pop(symbol, None)
        if not blocks:
            return None
        all_ = blocks[0] if len(blocks) == 1 else np.concatenate(blocks)
        self.held -= len(all_)
        return all_["pos"], all_["lcp"]

    def _load(self, group: int) -> None:
        from_disk: dict[int, list[np.ndarray]] = {}
        with open(self._name(group), "rb") as source:
            while head := source.read(16):
                symbol, n = np.frombuffer(head, "<i8")
                from_disk.setdefault(int(symbol), []).append(np.frombuffer(source.read(int(n) * self.KIND.itemsize), self.KIND))
                self.held += int(n)
        os.remove(self._name(group))
        self.on_disk.discard(group)
        for symbol, blocks in from_disk.items():
            self.blocks[symbol] = blocks + self.blocks.get(symbol, [])

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the end counts as the smallest symbol."""
    n = len(text)
    up = np.empty(n, bool)
    up[-1:] = False
    if n > 1:
        up[:-1] = text[:-1] < text[1:]
        flat = np.flatnonzero(text[:-1] == text[1:])
        if len(flat):
            ends = np.where(np.concatenate((text[:-1] != text[1:], [True])), np.arange(n), n)
            nearest = np.minimum.accumulate(ends[::-1])[::-1]
            up[flat] = up[nearest[flat]]
    return up


class Inducer:
    """One induction over a text: from sorted S* suffixes to all suffixes."""

    def __init__(self, text: np.ndarray, symbols: int, folder: str, memory: int, depth: int) -> None:
        self.text, self.symbols, self.folder, self.memory, self.depth = text, symbols, folder, memory, depth
        self.small = suffix_types(text)
        before = np.concatenate(([True], self.small[:-1]))
        self.stars = np.flatnonzero(self.small & ~before)

    def prefix(self, a: int, b: int) -> int:
        """Common prefix of two suffixes, read directly."""
        most = min(self.depth, len(self.text) - max(a, b))
        x, y = self.text[a : a + most], self.text[b : b + most]
        unequal = np.flatnonzero(x != y)
        return int(unequal[0]) if len(unequal) else most

    def _cause(self, queue: SymbolQueue, least: np.ndarray, pos: np.ndarray, lcp: np.ndarray, small: bool) -> None:
        """Pushes the suffixes one place before pos that have the given type."""
        for at in range(0, len(pos), CHUNK):
            p, c = pos[at : at + CHUNK], np.minimum(lcp[at : at + CHUNK], self.depth)
            able = np.flatnonzero(p > 0)
            able = able[self.small[p[able] - 1] == small]
            symbols = self.text[p[able] - 1]
            order = np.argsort(symbols, kind="stable")
            symbols, able = symbols[order], able[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(symbols)) + 1, [len(symbols)])) if len(symbols) else np.zeros(1, np.int64)
            new = {}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                symbol, places = int(symbols[a]), able[a:b]
                bounds = np.concatenate(([0], places + 1))
                tail = self.depth
                if bounds[-1] < len(c):
                    least_between = np.minimum.reduceat(c, bounds)
                    tail = int(least_between[-1])
                    least_between = least_between[:-1]
                else:
                    least_between = np.minimum.reduceat(c, bounds[:-1])
                least_between[0] = min(least_between[0], least[symbol])
                new[symbol] = tail
                queue.push(symbol, p[places] - 1, np.minimum(least_between + 1, self.depth))
            np.minimum(least, c.min(initial=self.depth), out=least)
            for symbol, tail in new.items():
                least[symbol] = tail

    def run(self, stars: np.ndarray, star_lcp: np.ndarray):
        """Yields (positions, common prefixes with the entry before) symbol by symbol, in order.

        stars: the S* positions in order (or, for naming, by first symbol alone).
        """
        n = len(self.text)
        used = np.flatnonzero(np.bincount(self.text, minlength=self.symbols)) if self.symbols <= 1 << 20 else np.unique(self.text)
        firsts = self.text[stars]
        starts, ends = np.searchsorted(firsts, used, "left"), np.searchsorted(firsts, used, "right")
        queue = SymbolQueue(self.folder, self.symbols, self.memory // 4)
        larges = SymbolQueue(self.folder, self.symbols, self.memory // 4)
        smalls = SymbolQueue(self.folder, self.symbols, self.memory // 4)
        try:
            least = np.full(self.symbols, self.depth, np.int32)
            if n:  # the empty suffix, before all others, causes the last
                queue.push(int(self.text[-1]), np.array([n - 1]), np.array([0], np.int32))
                least[:] = 0
                least[self.text[-1]] = self.depth
            for symbol, a, b in zip(used.tolist(), starts.tolist(), ends.tolist()):
                last = None
                while (found := queue.pop(symbol)) is not None:
                    pos, lcp = found
                    if last is None:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    larges.push(symbol, pos, lcp)
                    self._cause(queue, least, pos, lcp, False)
                    last = int(pos[-1])
                if b > a:
                    lcp = star_lcp[a:b].astype(np.int32)
                    lcp[0] = 0 if last is None else self.prefix(last, int(stars[a]))
                    self._cause(queue, least, stars[a:b], lcp, False)
            least[:] = self.depth
            seams: dict[int, int] = {}
            back = SymbolQueue(self.folder, self.symbols, self.memory // 4)
            try:
                for symbol in used.tolist()[::-1]:
                    last = None
                    while (found := queue.pop(symbol)) is not None:
                        pos, lcp = found
                        if last is None:
                            lcp = lcp.copy()
                            lcp[0] = 0
                        smalls.push(symbol, pos, lcp)
                        self._cause(queue, least, pos, lcp, True)
                        last = int(pos[-1])
                    found = larges.pop(symbol)
                    if found is not None:
                        pos, lcp = found
                        seam = 0 if last is None else self.prefix(int(pos[-1]), last)
                        seams[symbol] = seam
                        self._cause(queue, least, pos[::-1], np.concatenate((np.array([seam], np.int32), lcp[:0:-1])), True)
                        back.push(symbol, pos, lcp)
                for symbol in used.tolist():
                    found = back.pop(symbol)
                    if found is not None:
                        yield found
                    found = smalls.pop(symbol)
                    if found is not None:
                        pos, lcp = found
                        yield pos[::-1], np.concatenate((np.array([seams.get(symbol, 0)], np.int32), lcp[:0:-1]))
            finally:
                back.close()
        finally:
            queue.close()
            larges.close()
            smalls.close()


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string that fits in memory, by prefix doubling to ``depth``."""
    rank, k = names.astype(np.int64), 1
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.diff(key[order]) != 0)).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if k >= min(n, depth) or step[-1] == n - 1:
            return order


def _names(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names, by place of the star, of the substrings from each S* position to the next; order: sorted."""
    length = np.diff(np.concatenate((stars, [len(text)]))) + 1
    p, size = stars[order], length[order]
    same = size[1:] == size[:-1]
    same &= (p[1:] + size[1:] <= len(text)) & (p[:-1] + size[:-1] <= len(text))  # the end is a symbol of its own
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        left = left[size[left] > k]
        unequal = text[p[left] + k] != text[p[left + 1] + k]
        same[left[unequal]] = False
        left = left[~unequal]
        k += 1
    names = np.empty(len(stars), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    return names


def _prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    values = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    powers = np.full(len(text) + 1, base)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64))), powers


def star_prefixes(text: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of neighbouring S* suffixes, by binary search over prefix sums."""
    sums, powers = _prefix_sums(text)
    n = len(text)
    a, b = stars[:-1], stars[1:]
    most = np.minimum(depth, n - np.maximum(a, b))
    low = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(depth).bit_length() - 1)
    while step:
        size = low + step
        fits = np.flatnonzero(size <= most)
        x, y, s = a[fits], b[fits], size[fits]
        shift = np.abs(y - x)
        hx, hy = sums[x + s] - sums[x], sums[y + s] - sums[y]
        equal = np.where(x < y, hx * powers[shift] == hy, hy * powers[shift] == hx)
        low[fits[equal]] += step
        step >>= 1
    return np.concatenate((np.zeros(min(1, len(stars)), np.int64), low))


def star_order(inducer: Inducer) -> np.ndarray:
    """The S* positions of the text in the order of their suffixes."""
    text, stars = inducer.text, inducer.stars
    if len(stars) < 2:
        return stars
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    rough = stars[np.argsort(text[stars], kind="stable")]
    found = [pos[is_star[pos]] for pos, _ in inducer.run(rough, np.zeros(len(rough), np.int32))]
    place = np.searchsorted(stars, np.concatenate(found))
    names = _names(text, stars, place)
    n_names = int(names.max()) + 1
    if n_names == len(stars):
        return stars[place]
    if len(names) <= inducer.memory:
        return stars[_doubled(names, inducer.depth)]
    deeper = Inducer(names, n_names, inducer.folder, inducer.memory, inducer.depth)
    sorted_ = star_order(deeper)
    order = [pos for pos, _ in deeper.run(sorted_, np.zeros(len(sorted_), np.int32))]
    return stars[np.concatenate(order)]


def sorted_suffixes(text: np.ndarray, symbols: int, memory: int = 1 << 23, depth: int = 1 << 30, folder: str | None = None):
    """Yields blocks of (positions, common prefixes with the suffix before) of all suffixes in order.

    text: integers below ``symbols``; it may be a memory map. Disk in ``folder`` (the task's own
    scratch by default) is freed at the end.
    """
    scratch = tempfile.mkdtemp(dir=folder)
    try:
        inducer = Inducer(text, symbols, scratch, memory, min(depth, len(text)))
        stars = star_order(inducer)
        yield from inducer.run(stars, star_prefixes(text, stars, inducer.depth))
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
