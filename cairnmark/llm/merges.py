"""Rank-synchronous merging of many symbol sequences held as ragged arrays.

A ``MergeTable`` knows, for every pair of neighbouring symbols that may be
joined, the rank (lowest first) and the joined symbol. ``merge`` applies, in
each round, the lowest-ranked pair of every sequence (the leftmost of equals)
to all sequences at once, and retires those in which no pair is left. A
sequence of more than ``LONG`` symbols would need as many rounds as it has
merges, so its lowest pair is found with a heap instead; the merges are the
same.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np

LONG = 192
_NONE = np.iinfo(np.int64).max


@dataclass
class MergeTable:
    """Sorted pair keys with their ranks and results; ``base`` is above every symbol."""

    base: int
    keys: np.ndarray
    ranks: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, pairs: dict[tuple[int, int], tuple[int, int]], base: int) -> MergeTable:
        keys = np.fromiter((a * base + b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        joined = np.fromiter((j for _, j in pairs.values()), np.int64, len(pairs))
        order = np.argsort(keys)
        return cls(base, keys[order], ranks[order], joined[order])

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


def merge(symbols: np.ndarray, counts: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive, sequence after sequence, and how many each has."""
    counts = np.asarray(counts, np.int64)
    out: list[np.ndarray | None] = [None] * len(counts)
    ends = np.cumsum(counts)
    long = np.flatnonzero(counts > LONG)
    for i in long:
        out[i] = _merge_long(symbols[ends[i] - counts[i] : ends[i]], table)
    which = np.flatnonzero((counts <= LONG) & (counts > 0))
    keep = np.repeat((counts <= LONG), counts)
    sym, cnt = symbols[keep].astype(np.int64), counts[which]
    done_sym, done_cnt, done_id = [], [], []
    while len(which):
        starts = np.cumsum(cnt) - cnt
        score = np.full(len(sym), _NONE)
        if len(sym) > 1:
            at = table.find(sym[:-1], sym[1:])
            at[starts[1:] - 1] = -1
            hit = np.flatnonzero(at >= 0)
            score[hit] = (table.ranks[at[hit]] << 32) | hit
        best = np.minimum.reduceat(score, starts)
        alive = best != _NONE
        if not alive.all():
            stays = np.repeat(alive, cnt)
            done_sym.append(sym[~stays])
            done_cnt.append(cnt[~alive])
            done_id.append(which[~alive])
            moved = np.cumsum(stays) - 1
            place = moved[(best[alive] & 0xFFFFFFFF).astype(np.int64)]
            results = table.joined[at[(best[alive] & 0xFFFFFFFF).astype(np.int64)]] if alive.any() else place
            sym, cnt, which = sym[stays], cnt[alive], which[alive]
        else:
            place = (best & 0xFFFFFFFF).astype(np.int64)
            results = table.joined[at[place]]
        if len(which):
            sym[place] = results
            left = np.ones(len(sym), bool)
            left[place + 1] = False
            sym, cnt = sym[left], cnt - 1
    final = np.zeros(len(counts), np.int64)
    for s, c, i in zip(done_sym, done_cnt, done_id, strict=True):
        final[i] = c
    for i in long:
        final[i] = len(out[i])
    flat = np.empty(int(final.sum()), np.int64)
    begin = np.cumsum(final) - final
    for s, c, i in zip(done_sym, done_cnt, done_id, strict=True):
        at = np.arange(len(s)) + np.repeat(begin[i] - (np.cumsum(c) - c), c)
        flat[at] = s
    for i in long:
        flat[begin[i] : begin[i] + final[i]] = out[i]
    return flat, final


def _merge_long(symbols: np.ndarray, table: MergeTable) -> np.ndarray:
    """The same merges in one long sequence."""
    sym = symbols.astype(np.int64).tolist()
    n = len(sym)
    at = table.find(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
    heap = [(int(table.ranks[k]), i, i + 1, int(table.joined[k])) for i, k in enumerate(at.tolist()) if k >= 0]
    heapq.heapify(heap)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int] | None] = {}
    version = [0] * n
    made = {(i, i + 1): (0, 0) for _, i, _, _ in heap}

    def offer(i: int, j: int) -> None:
        pair = (sym[i], sym[j])
        if pair not in known:
            k = int(table.find(np.array([pair[0]]), np.array([pair[1]]))[0])
            known[pair] = (int(table.ranks[k]), int(table.joined[k])) if k >= 0 else None
        if known[pair]:
            made[i, j] = (version[i], version[j])
            heapq.heappush(heap, (known[pair][0], i, j, known[pair][1]))

    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if sym[i] < 0 or j >= n or sym[j] < 0 or following[i] != j or made.get((i, j)) != (version[i], version[j]):
            continue
        k = known.get((sym[i], sym[j]))
        if k and k[1] != joined:
            continue
        sym[i], sym[j] = joined, -1
        version[i] += 1
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
            offer(i, following[i])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([x for x in sym if x >= 0], np.int64)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteMerges:
    """Byte-level merges by rank, as a rank file defines them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 257
        self.symbol = dict(ranks)
        for b in range(256):  # a byte without a rank of its own still is a symbol
            self.symbol.setdefault(bytes([b]), size - 256 + b)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = self.symbol.get(token[:cut]), self.symbol.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        self.table = MergeTable.of(pairs, size)
        self.first = np.array([self.symbol[bytes([b])] for b in range(256)], np.int64)
        n = max(ranks.values(), default=-1) + 1
        by_id = [b""] * n
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_offs = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens back to back, and how many each has; a pre-token that is a token is that token."""
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        whole = np.fromiter((self.ranks.get(x, -1) for x in tokens), np.int64, len(tokens))
        flat = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        todo = whole < 0
        ids, n = merge(flat[np.repeat(todo, counts)], counts[todo], self.table)
        final = np.ones(len(tokens), np.int64)
        final[todo] = n
        out = np.empty(int(final.sum()), np.int64)
        at = np.repeat(todo, final)
        out[at] = ids
        out[~at] = whole[~todo]
        return out, final
