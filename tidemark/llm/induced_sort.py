"""Suffix sorting by induction, with common-prefix values, in batches over queues that can spill.

Suffixes are typed as in induced sorting: the sorted suffixes that start at leftmost smaller
positions decide the order of all others. Tuples (position, common prefix with the tuple before)
wait in one queue for each first symbol; taking the queues in symbol order, and each in the order
of arrival, is a priority queue whose keys are small integers. A whole queue is taken as one NumPy
batch, so a shard costs array operations, not a Python step for each suffix. Queues beyond
``memory`` bytes are kept in an unlinked scratch file of the task, which ends with the task.

The recursion sorts the string of names of the leftmost-smaller substrings, where it stops at the
common-prefix depth asked for: ranks of pairs, pairs of pairs and so on, until ``depth`` symbols
are told apart. Suffixes equal to that depth may come in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

END, BREAK, SHIFT = 0, 1, 2  # symbols below the bytes: the end, and what parts two strings


class Queues:
    """First-in first-out queues of (positions, common prefixes), by symbol."""

    def __init__(self, symbols: int, memory: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        size = places.nbytes + common.nbytes
        if self.held + size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            places.tofile(self.file)
            common.tofile(self.file)
            self.parts[symbol].append((at, len(places)))
        else:
            self.held += size
            self.parts[symbol].append((places, common))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts[symbol] = self.parts[symbol], []
        found = []
        for first, second in parts:
            if isinstance(first, int):
                self.file.seek(first)
                found.append((np.fromfile(self.file, np.int32, second), np.fromfile(self.file, np.int16, second)))
            else:
                self.held -= first.nbytes + second.nbytes
                found.append((first, second))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def smaller_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end counts as such."""
    step = np.sign(np.diff(text.astype(np.int32)))
    known = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(known[::-1])[::-1] if len(step) else known
    out = np.ones(len(text), bool)
    out[:-1] = np.append(step, 1)[following] > 0
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, counted up to ``depth``, by comparing them.

    ``text`` has ``depth`` more symbols than the places a and b can take.
    """
    out = np.zeros(len(a), np.int16)
    open_, done = np.arange(len(a)), 0
    for width in (8, 24, 96, depth):
        width = min(width, depth - done)
        if not len(open_) or width <= 0:
            break
        span, still = np.arange(width), []
        for part in np.array_split(open_, max(1, len(open_) * width // (4 << 20))):
            differ = text[(a[part] + done)[:, None] + span] != text[(b[part] + done)[:, None] + span]
            first = np.where(differ.any(1), differ.argmax(1), width)
            out[part] += first.astype(np.int16)
            still.append(part[first == width])
        open_, done = np.concatenate(still), done + width
    return out


class RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over low..high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in range(level.min(initial=0), level.max(initial=0) + 1):
            own = level == k
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - 2**k + 1])
        return out


class Induction:
    def __init__(self, text: np.ndarray, depth: int, memory: int = 256 << 20):
        self.text, self.depth, self.memory = text, depth, memory
        self.padded = np.append(text, np.zeros(depth, text.dtype))
        self.small = smaller_type(text)
        left = self.small.copy()
        left[1:] &= ~self.small[:-1]
        left[0] = False
        self.left = np.flatnonzero(left).astype(np.int32)
        self.symbols = int(text.max()) + 1
        self.tracking = True

    def scan(self, queues: Queues, places: np.ndarray, common: np.ndarray, small: bool, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sends the predecessors of a sorted batch to their queues and returns those that start
        with the batch's own symbol. ``running`` holds, for each symbol, the least common prefix
        met since the last tuple that went to its queue."""
        none = np.zeros(0, np.int32), np.zeros(0, np.int16)
        if not len(places):
            return none
        before = places - 1
        at = np.flatnonzero((places > 0) & (self.small[before] == small))
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        again = np.zeros(len(at), bool)
        again[1:] = symbol[1:] == symbol[:-1]
        starts = np.flatnonzero(~again)
        value = self.carried(common, at, again, symbol, starts, running) if self.tracking else np.zeros(len(at), np.int16)
        own, own_symbol = none, self.text[places[0]]
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist()):
            part = before[at[s:e]].astype(np.int32), value[s:e]
            if symbol[s] == own_symbol:
                own = part
            else:
                queues.push(int(symbol[s]), *part)
        return own

    def carried(self, common: np.ndarray, at: np.ndarray, again: np.ndarray, symbol: np.ndarray, starts: np.ndarray, running: np.ndarray) -> np.ndarray:
        """Common prefixes of the predecessors: one more than the least met between two tuples
        that go to the same queue."""
        minimum = RangeMinimum(common)
        low = np.zeros(len(at), np.int64)
        low[again] = at[:-1][again[1:]] + 1
        value = minimum(low, at) if len(at) else np.zeros(0, np.int16)
        value[~again] = np.minimum(value[~again], running[symbol[~again]])
        np.minimum(running, common.min(), out=running)
        if len(starts):
            last = at[np.append(starts[1:], len(at)) - 1]
            tail = np.full(len(starts), self.depth, np.int16)
            more = last + 1 < len(common)
            tail[more] = minimum(last[more] + 1, np.full(more.sum(), len(common) - 1))
            running[symbol[starts]] = tail
        return np.minimum(value + 1, self.depth).astype(np.int16)

    def seam(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return common_prefix(self.padded, upper, lower, self.depth) if self.tracking else np.zeros(len(upper), np.int16)

    def order(self, seeds: np.ndarray, seed_common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order from sorted seeds, with the common prefix of each and the one
        before it."""
        first = self.text[seeds]
        bounds = np.searchsorted(first, np.arange(self.symbols + 1))
        queues, running = Queues(self.symbols, self.memory), np.zeros(self.symbols, np.int16)
        large: list[tuple[np.ndarray, np.ndarray]] = []
        for symbol in range(self.symbols):
            running[:] = 0
            places, common = queues.take(symbol)
            rounds = [(places, common)]
            while len(rounds[-1][0]):
                batch, shared = rounds[-1]
                shared = shared.copy()
                if len(rounds) == 1:
                    shared[0] = 0
                rounds.append(self.scan(queues, batch, shared, False, running))
            places, common = np.concatenate([r[0] for r in rounds]), np.concatenate([r[1] for r in rounds])
            large.append((places, common))
            own, shared = seeds[bounds[symbol] : bounds[symbol + 1]], seed_common[bounds[symbol] : bounds[symbol + 1]].copy()
            if len(own):
                shared[0] = self.seam(places[-1:], own[:1])[0] if len(places) else 0
                self.scan(queues, own, shared, False, running)
        queues, running = Queues(self.symbols, self.memory), np.zeros(self.symbols, np.int16)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for symbol in range(self.symbols - 1, -1, -1):
            running[:] = 0
            rounds = [queues.take(symbol)]
            if symbol == END:
                rounds = [(np.array([len(self.text) - 1], np.int32), np.zeros(1, np.int16))]
            while len(rounds[-1][0]):
                batch, shared = rounds[-1]
                shared = shared.copy()
                if len(rounds) == 1:
                    shared[0] = 0
                rounds.append(self.scan(queues, batch, shared, True, running))
            places, common = np.concatenate([r[0] for r in rounds]), np.concatenate([r[1] for r in rounds])
            big, big_common = large[symbol]
            if len(big):
                # downwards, a tuple's value is that with the tuple above it
                down = np.append(big_common[1:], np.int16(0))[::-1].copy()
                down[0] = self.seam(big[-1:], places[-1:])[0] if len(places) else 0
                self.scan(queues, big[::-1], down, True, running)
            both, values = np.concatenate([big, places[::-1]]), np.concatenate([big_common, np.append(np.int16(0), common[1:][::-1])[: len(places)]])
            if len(big) and len(places):
                values[len(big)] = self.seam(big[-1:], places[-1:])[0]
            if len(values):
                values[0] = 0
            out.append((both, values))
        out.reverse()
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the leftmost-smaller substrings, in text order and in order of their contents."""
        rough = self.left[np.argsort(self.text[self.left], kind="stable")]
        self.tracking = False
        order, _ = self.order(rough, np.zeros(len(rough), np.int16))
        self.tracking = True
        is_left = np.zeros(len(self.text), bool)
        is_left[self.left] = True
        ordered = order[is_left[order]]
        place = np.zeros(len(self.text), np.int64)
        place[self.left] = np.arange(len(self.left))
        length = np.diff(np.append(self.left, len(self.text) - 1)) + 1
        own = length[place[ordered]]
        same = np.zeros(len(ordered), bool)
        alike = np.flatnonzero(own[1:] == own[:-1]) + 1
        cap = np.minimum(own[alike], self.depth)
        shared = common_prefix(self.padded, ordered[alike - 1], ordered[alike], self.depth)
        same[alike] = shared >= cap
        names = np.zeros(len(self.left), np.int64)
        names[place[ordered]] = np.cumsum(~same)
        return names, length

    def sorted_left(self) -> np.ndarray:
        """The leftmost-smaller suffixes in order, to the depth asked for."""
        if len(self.left) < 2:
            return self.left
        rank, length = self.named()
        covered, span = length.min() - 1, 1
        reach = np.append(np.cumsum(length - 1), 0)
        while rank.max() < len(rank):
            following = np.zeros(len(rank), np.int64)
            following[:-span] = rank[span:]
            key = rank * (int(rank.max()) + 1) + following
            _, rank = np.unique(key, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            span *= 2
            if span >= len(rank):
                break
            covered = (reach[span - 1 : -1] - np.append(0, reach[: -span - 1])).min() if span < len(reach) else self.depth
            if covered >= self.depth:
                break
        return self.left[np.argsort(rank, kind="stable")]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        seeds = self.sorted_left()
        common = np.zeros(len(seeds), np.int16)
        if len(seeds) > 1:
            common[1:] = common_prefix(self.padded, seeds[:-1], seeds[1:], self.depth)
        return self.order(seeds, common)


def join_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One text of all strings with a break after each and the end last, and where each starts."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.append(0, np.cumsum(sizes + 1))
    text = np.full(int(starts[-1]) + 1, BREAK, np.uint16)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    text[np.arange(len(joined)) + np.repeat(np.arange(len(strings)), sizes)] = joined.astype(np.uint16) + SHIFT
    text[-1] = END
    return text, starts[:-1]


def repeated_starts(strings: list[bytes], width: int, memory: int = 256 << 20) -> np.ndarray:
    """For each place of ``join_strings``: whether the ``width`` bytes from there occur elsewhere."""
    text, _ = join_strings(strings)
    order, common = Induction(text, width, memory).run()
    long = common >= width
    out = np.zeros(len(text), bool)
    out[order[long]] = True
    out[order[np.flatnonzero(long) - 1]] = True
    return out
