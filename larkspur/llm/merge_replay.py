"""Byte-pair merges replayed over many words at once, in the order of their ranks."""

from __future__ import annotations

import gc
import heapq
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np


#: Pairs of tokens whose ranks are remembered from one replay to the next.
KNOWN_PAIRS = 1_000_000


class MergeReplay:
    """Encodes words by the ranks of a byte-level vocabulary (bytes of a token to its id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of each pair of bytes, -1 where the vocabulary has no such token.
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        single = self.single.tolist()
        self.pairs = {single[i >> 8] << 32 | single[i & 255]: int(r) for i, r in enumerate(self.first) if r >= 0}
        #: Rank of pairs of tokens met so far.
        self.known = dict(self.pairs)

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token itself is that token; words are empty or not, and may repeat."""
        whole = [self.ranks.get(w) for w in words]
        parts = [w for w, rank in zip(words, whole, strict=True) if rank is None]
        collects = gc.isenabled()
        gc.disable()  # the index is many small lists without cycles
        try:
            replayed = iter(self._replay(parts))
        finally:
            if collects:
                gc.enable()
        return [next(replayed) if rank is None else [rank] for rank in whole]

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        """All words lie end to end, a place for each byte, joined to its neighbours of the same word. `places` is the
        inverted index: from a rank to the places at which a pair of that rank starts. The least rank that has places goes
        first; each merge looks only at the two pairs that it makes. A pair that a merge made with a lower rank than
        its own goes before the word's later places, which then wait for their rank's next turn."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]).tolist()
        if not len(data):
            return [[] for _ in words]
        start_of_word = np.zeros(len(data) + 1, bool)
        start_of_word[[0, *ends]] = True
        token = self.single[data].tolist()
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[start_of_word[1:]] = -1
        before[start_of_word[:-1]] = -1
        pair = np.full(len(data), -1, np.int64)
        pair[:-1] = self.first[data[:-1].astype(np.int64) * 256 + data[1:]]
        pair[start_of_word[1:]] = -1
        order = np.argsort(pair, kind="stable")
        found, starts = np.unique(pair[order], return_index=True)
        places = {int(r): p.tolist() for r, p in zip(found, np.split(order, starts[1:]), strict=True) if r >= 0}
        after, before = after.tolist(), before.tolist()
        if len(self.known) > KNOWN_PAIRS:
            self.known = dict(self.pairs)
        known, heap = self.known, list(places)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            waits_to, waiting = -1, []
            for p in sorted(places.pop(rank)):
                if p < waits_to:
                    waiting.append(p)
                    continue
                q = after[p]
                if q < 0 or token[p] < 0 or known.get(token[p] << 32 | token[q]) != rank:
                    continue  # a merge has changed the pair since
                token[p], token[q] = rank, -1
                beyond, back, low = after[q], before[p], False
                after[p] = beyond
                if beyond >= 0:
                    before[beyond] = p
                    new = known.get(rank << 32 | token[beyond])
                    if new is None:
                        new = self._learn(rank, token[beyond])
                    if new >= 0:
                        low = new < rank
                        if new in places:
                            places[new].append(p)
                        else:
                            places[new] = [p]
                            heapq.heappush(heap, new)
                if back >= 0:
                    new = known.get(token[back] << 32 | rank)
                    if new is None:
                        new = self._learn(token[back], rank)
                    if new >= 0:
                        low = low or new < rank
                        if new in places:
                            places[new].append(back)
                        else:
                            places[new] = [back]
                            heapq.heappush(heap, new)
                if low:
                    waits_to = ends[bisect_right(ends, p)]
            if waiting:
                if rank in places:
                    places[rank] += waiting
                else:
                    places[rank] = waiting
                    heapq.heappush(heap, rank)
        out, begin = [], 0
        for end in ends:
            out.append([t for t in token[begin:end] if t >= 0])
            begin = end
        return out

    def _learn(self, a: int, b: int) -> int:
        rank = self.known[a << 32 | b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return rank
