"""The Burrows-Wheeler transform, common prefixes and suffixes of a collection of strings, built column by column.

Each round puts one more symbol of every string in front of its last suffix, so all suffixes of one length enter
together. Where a suffix c.S goes follows from the transform so far: after all suffixes that begin with smaller symbols
and after as many as there are symbols c before the place of S. Its common prefix with its neighbours is one more than
the smallest common prefix between the places of their tails. Transform, prefixes and suffix names are kept as files
that each round reads once from front to back and writes anew, block by block; a collection of one block stays in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.fs

#: Suffixes of a block, about 6 bytes each.
BLOCK = 4_000_000
#: bwt, common prefix, name of each suffix; a whole string's name is stored as -1 - name.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]



class Column:
    """A sequence of blocks of suffixes that is written once and read in order: in memory up to one block, else in a file."""

    def __init__(self, folder: str | None, block: int, name: np.dtype):
        self.folder, self.block, self.path, self.size = folder, block, None, 0
        self.kinds = (np.dtype("u1"), np.dtype("u1"), name)
        self.blocks: list[Block] = []
        self.out = None

    def append(self, entries: Block) -> None:
        self.size += len(entries[0])
        if self.folder is not None and self.size > self.block and self.out is None:
            self.fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
            self.path = f"{base}/bwt-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.path)
            for b in self.blocks:
                self._write(b)
            self.blocks = []
        if self.out is not None:
            self._write(entries)
        else:
            self.blocks.append(entries)

    def _write(self, entries: Block) -> None:
        self.out.write(np.int64(len(entries[0])).tobytes() + b"".join(x.tobytes() for x in entries))

    def read(self) -> Iterator[tuple[Block, bool]]:
        """The blocks, and for each if it is the last."""
        if self.out is None:
            yield from ((b, k == len(self.blocks) - 1) for k, b in enumerate(self.blocks))
            return
        self.out.close()
        left = self.size
        with self.fs.open_input_stream(self.path) as source:
            while left:
                n = int(np.frombuffer(source.read(8), np.int64)[0])
                left -= n
                yield tuple(np.frombuffer(source.read(n * k.itemsize), k) for k in self.kinds), not left

    def drop(self) -> None:
        if self.path is not None:
            self.out.close()
            self.fs.delete_file(self.path)
        self.blocks = []


def build(strings: list[bytes], cap: int = 255, folder: str | None = None, block: int = BLOCK) -> Column:
    """All suffixes of strings (255 bytes at most, no zero bytes needed) in order: bwt, lcp (held to cap) and name.

    name is 256 * string number + suffix length, and -1 - that for a whole string, before which no byte stands. Ends differ from all bytes and from each other, so no common prefix
    runs over an end. folder: where files go when a collection outgrows a block.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    width = int(size.max(initial=0))
    # right-aligned: column -1 is each string's last symbol
    text = np.frombuffer(b"".join(s.rjust(width, b"\0") for s in strings), np.uint8).reshape(m, width) if m else np.zeros((0, 0), np.uint8)
    kind = np.dtype("<i4" if m < 1 << 22 else "<i8")
    now = Column(folder, block, kind)
    for k in range(0, m, block):
        names = np.arange(k, min(m, k + block)) * 256
        now.append((text[k : k + block, -1].copy() if width else np.zeros(len(names), np.uint8), np.zeros(len(names), np.uint8), np.where(size[k : k + block] > 0, names, -1 - names).astype(kind)))
    totals = np.bincount(text[size > 0, -1] if width else np.zeros(0, np.uint8), minlength=256).astype(np.int64)  # symbols not yet or already put in front
    live = np.flatnonzero(size > 0)
    place = live.copy()  # of each live string's last suffix, among all
    for depth in range(1, width + 1):
        # first reading: where each new suffix goes, and the common prefixes that it makes
        order = np.argsort(place, kind="stable")
        live, place = live[order], place[order]
        first = np.concatenate([[0], np.cumsum(totals)[:-1]]) + m  # the new place of the first suffix of each symbol
        before = np.zeros(256, np.int64)
        lowest = np.full(256, -1, np.int64)  # smallest common prefix since each symbol's last place; -1: none so far
        pending = np.zeros(256, bool)  # was each symbol's last place a new suffix?
        goes = np.empty(len(live), np.int64)
        prefix_at, prefix_is = [], []
        at = k = 0
        for (bwt, lcp, name), last in now.read():
            n = len(bwt)
            sym = np.flatnonzero(name >= 0)
            byte = bwt[sym] if len(sym) < n else bwt
            by = np.argsort(byte, kind="stable")
            spot = sym[by] if len(sym) < n else by
            count = np.bincount(byte, minlength=256)
            begin = np.concatenate([[0], np.cumsum(count)])
            j = int(np.searchsorted(place, at + n))
            here = place[k:j] - at
            c = bwt[here].astype(np.int64)
            # the rank of each place within its symbol: places of one symbol ascend in spot
            mine = np.searchsorted(_keys(spot, count, n), c * n + here)
            goes[k:j] = first[c] + before[c] + mine - begin[c]
            # common prefixes are needed of the new ones, and of the next of the same symbol after a new one
            heads = begin[:-1][count > 0]
            wanted = np.zeros(len(spot) + 1, bool)
            wanted[mine] = True
            wanted[mine[mine + 1 < begin[c + 1]] + 1] = True
            wanted[heads[pending[count > 0]]] = True
            need = np.flatnonzero(wanted)
            if len(need):
                b = np.searchsorted(begin, need, side="right") - 1
                head = need == begin[b]
                start = np.where(head, 0, spot[need - 1] + 1)
                low = np.minimum.reduceat(np.append(lcp, np.uint8(255)), np.stack([start, spot[need] + 1], 1).ravel())[::2].astype(np.int64)
                low = np.where(head, np.where(lowest[b] < 0, -1, np.minimum(low, lowest[b])), low)
                prefix_at.append(first[b] + before[b] + need - begin[b])
                prefix_is.append(np.minimum(low + 1, cap))
            if not last:  # carried over to the next block
                new = np.zeros(len(spot), bool)
                new[mine] = True
                rest = np.minimum.accumulate(np.append(lcp, np.uint8(255))[::-1])[::-1].astype(np.int64)  # smallest from here to the block's end
                ends = np.maximum(begin[1:] - 1, 0)
                lowest = np.where(lowest < 0, -1, np.minimum(lowest, rest[0]))
                if len(spot):
                    lowest = np.where(count > 0, rest[spot[np.minimum(ends, len(spot) - 1)] + 1], lowest)
                    pending = np.where(count > 0, new[np.minimum(ends, len(spot) - 1)], pending)
                before += count
            at, k = at + n, j
        # the new suffixes in the order of their places
        by = np.argsort(goes, kind="stable")
        live, goes = live[by], goes[by]
        more = size[live] > depth
        symbols = np.zeros(len(live), np.uint8)
        symbols[more] = text[live[more], width - depth - 1]
        names = live * 256 + depth
        names[~more] = -1 - names[~more]
        prefix_at = np.concatenate(prefix_at) if prefix_at else np.zeros(0, np.int64)
        prefix_is = np.concatenate(prefix_is) if prefix_is else np.zeros(0, np.int64)
        by = np.argsort(prefix_at, kind="stable")
        prefix_at, prefix_is = prefix_at[by], prefix_is[by].astype(np.uint8)
        # second reading: old and new, merged
        then = Column(folder, block, kind)
        done = k = p = 0
        for (bwt, lcp, name), last in now.read():
            n, j = len(bwt), k
            while not last:  # new suffixes that stand before the end of this block's old ones
                grown = int(np.searchsorted(goes, done + n + (j - k), side="left"))
                if grown == j:
                    break
                j = grown
            j = len(goes) if last else j
            put = goes[k:j] - done
            keep = np.ones(n + j - k, bool)
            keep[put] = False
            out = tuple(np.empty(len(keep), kind) for kind in now.kinds)
            for x, old, new in zip(out, (bwt, lcp, name), (symbols[k:j], 0, names[k:j]), strict=True):
                x[keep] = old
                x[put] = new
            q = len(prefix_at) if last else int(np.searchsorted(prefix_at, done + len(keep)))
            out[1][prefix_at[p:q] - done] = prefix_is[p:q]
            then.append(out)
            done, k, p = done + len(keep), j, q
        now.drop()
        now = then
        totals += np.bincount(symbols[more], minlength=256)
        live, place = live[more], goes[more]
    return now


def _keys(spot: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Places in a block, sorted by symbol, as ascending numbers symbol * n + place."""
    return spot + np.repeat(np.arange(256) * n, count)


def smallest_owner(strings: list[bytes], owner: np.ndarray, window: int, folder: str | None = None, block: int = BLOCK) -> Callable[[int], np.ndarray]:
    """For each string and each of its windows of `window` bytes, the smallest owner of a string that holds this window too."""
    size = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([[0], np.cumsum(np.maximum(0, size - window + 1))])
    found = np.empty(base[-1], np.int64)
    if len(strings):
        built = build(strings, window, folder, block)
        held: list[np.ndarray] = []  # the names of the last group, which the next block may go on with

        def close(names: np.ndarray, edges: np.ndarray) -> None:
            who, length = names // 256, names % 256
            low = np.minimum.reduceat(owner[who], edges)
            rows = length >= window
            found[base[who[rows]] + size[who[rows]] - length[rows]] = np.repeat(low, np.diff(np.append(edges, len(names))))[rows]

        for (_, lcp, name), _ in built.read():
            name = np.where(name < 0, -1 - name, name)
            edges = np.flatnonzero(lcp < window)
            last = int(edges[-1]) if len(edges) else None
            if last is None:
                held.append(name)
                continue
            names = np.concatenate([*held, name[:last]]) if held or last else None
            if names is not None and len(names):
                shift = sum(map(len, held))
                inner = edges[edges < last] + shift
                close(names, inner if len(inner) and inner[0] == 0 else np.concatenate([[0], inner]))
            held = [name[last:]]
        if held:
            close(np.concatenate(held), np.array([0]))
        built.drop()
    return lambda k: found[base[k] : base[k + 1]]
