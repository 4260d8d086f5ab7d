"""Suffix arrays over concatenated titles: numbers instead of strings, searched many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillspan.llm.blobs import U, deltas, groups, mix, pack, undelta, unpack

#: Pairs of records compared at once, and words up to which they are compared as a matrix; bound memory only.
TILE, WIDE = 1 << 16, 24
ODD = U(0x9E3779B97F4A7C15)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] places, then the same for the others."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total, dtype=np.int64)


def suffix_order(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of suffixes symbols[begin:end]; equal ones stay as they are.

    Sorted by the first symbol; only suffixes that are still equal are told apart by the next one.
    """
    order = np.argsort(symbols[begin], kind="stable")
    head = groups(symbols[begin][order])
    size = np.diff(np.append(head, len(order)))
    group = np.repeat(head, size)  # a group of equal suffixes is named by its first place
    tied = np.flatnonzero(np.repeat(size > 1, size))
    depth = 1
    while len(tied):
        s = order[tied]
        goes_on = begin[s] + depth < end[s]
        following = np.where(goes_on, symbols[np.minimum(begin[s] + depth, len(symbols) - 1)], U(0))
        by = np.lexsort((following, goes_on, group[tied]))
        order[tied] = s[by]
        g, f, w = group[tied], following[by], goes_on[by]
        head = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (f[1:] != f[:-1]) | (w[1:] != w[:-1]))))
        size = np.diff(np.append(head, len(tied)))
        group[tied] = np.repeat(tied[head], size)
        tied = tied[np.repeat(size > 1, size) & w]
        depth += 1
    return order


@dataclass
class Titles:
    """Records in arrival order, their titles as one concatenated text, and the suffix array of it.

    A title's text is its words in one global order. A symbol of the text is a word together with the record's
    scope (the numbers of its title), so suffixes of different scopes never match. seed holds the offsets at which
    suffixes begin, in the order of the suffixes once sorted() is called.
    """

    batch: np.ndarray
    rec: np.ndarray
    at: np.ndarray
    scope: np.ndarray
    size: np.ndarray
    words: np.ndarray
    seed: np.ndarray
    seed_of: np.ndarray

    @staticmethod
    def empty() -> Titles:
        z = np.zeros(0, np.int64)
        return Titles(z, z, z, z.astype(U), z, z.astype(U), z, z)

    def pack(self) -> bytes:
        known, code = np.unique(self.words, return_inverse=True)
        scopes, scope = np.unique(self.scope, return_inverse=True)
        small = lambda a: a.astype(np.int32)
        return pack(deltas(self.batch), deltas(self.rec), deltas(self.at), scopes, small(scope), small(self.size), known, small(code), small(self.seed), small(self.seed_of))

    @staticmethod
    def read(blob: bytes) -> Titles:
        batch, rec, at, scopes, scope, size, known, code, seed, seed_of = unpack(blob)
        big = lambda a: a.astype(np.int64)
        return Titles(undelta(batch), undelta(rec), undelta(at), scopes[scope], big(size), known[code], big(seed), big(seed_of))

    @staticmethod
    def join(parts: list[Titles]) -> Titles:
        """Parts of different records as one, in arrival order; the suffixes are not sorted yet."""
        if not parts:
            return Titles.empty()
        shift = np.cumsum([0] + [len(p.rec) for p in parts])
        text = np.cumsum([0] + [len(p.words) for p in parts])
        batch, rec, at, scope, size, words = (np.concatenate([getattr(p, k) for p in parts]) for k in ("batch", "rec", "at", "scope", "size", "words"))
        seed = np.concatenate([p.seed + t for p, t in zip(parts, text, strict=False)])
        seed_of = np.concatenate([p.seed_of + s for p, s in zip(parts, shift, strict=False)])
        order = np.lexsort((rec, batch))
        start = np.cumsum(size) - size
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        new_start = np.cumsum(size[order]) - size[order]
        seed = seed - start[seed_of] + new_start[place[seed_of]]
        return Titles(batch[order], rec[order], at[order], scope[order], size[order], words[ranges(start[order], size[order])], seed, place[seed_of])

    def only(self, keep: np.ndarray) -> Titles | None:
        """The records of a mask with their suffixes, or None."""
        if not keep.any():
            return None
        start = self.ends() - self.size
        place = np.cumsum(keep) - 1
        size = self.size[keep]
        held = np.cumsum(size) - size
        mine = keep[self.seed_of]
        of = self.seed_of[mine]
        return Titles(self.batch[keep], self.rec[keep], self.at[keep], self.scope[keep], size, self.words[ranges(start[keep], size)], self.seed[mine] - start[of] + held[place[of]], place[of])

    def symbols(self) -> np.ndarray:
        return mix(self.words * ODD + np.repeat(self.scope, self.size), 3)

    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)

    def sorted(self) -> Titles:
        arrival = np.lexsort((self.seed, self.seed_of))
        seed, of = self.seed[arrival], self.seed_of[arrival]
        order = suffix_order(self.symbols(), seed, self.ends()[of])
        self.seed, self.seed_of = seed[order], of[order]
        return self


def shared_words(a: Titles, i: np.ndarray, b: Titles, j: np.ndarray) -> np.ndarray:
    """How many words records i of a and j of b have in common, pair by pair."""
    out = np.zeros(len(i), dtype=np.int64)
    a_start, b_start = a.ends() - a.size, b.ends() - b.size
    wide = np.maximum(a.size[i], b.size[j]) > WIDE
    rows = np.flatnonzero(~wide)
    for lo in range(0, len(rows), TILE):
        k = rows[lo : lo + TILE]
        x, y = i[k], j[k]
        columns = np.arange(int(b.size[y].max()))
        right = b.words[np.minimum(b_start[y][:, None] + columns, len(b.words) - 1)]
        inside = columns < b.size[y][:, None]
        n = np.zeros(len(k), dtype=np.int64)
        for c in range(int(a.size[x].max())):
            word = a.words[np.minimum(a_start[x] + c, len(a.words) - 1)]
            n += ((right == word[:, None]) & inside).any(axis=1) & (c < a.size[x])
        out[k] = n
    rows = np.flatnonzero(wide)
    at = 0
    while at < len(rows):  # long titles: as many pairs as hold some two million words
        words = np.cumsum(a.size[i[rows[at:]]] + b.size[j[rows[at:]]])
        k = rows[at : at + max(1, int(np.searchsorted(words, 2_000_000)))]
        both = np.concatenate([a.words[ranges(a_start[i[k]], a.size[i[k]])], b.words[ranges(b_start[j[k]], b.size[j[k]])]])
        pair = np.concatenate([np.repeat(np.arange(len(k)), a.size[i[k]]), np.repeat(np.arange(len(k)), b.size[j[k]])])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
        out[k] = np.bincount(pair[1:][same], minlength=len(k))
        at += len(k)
    return out


class Index:
    """A sorted suffix array made ready for searches."""

    def __init__(self, s: Titles):
        self.s = s
        self.symbols = s.symbols()
        self.ends = s.ends()
        self.first = self.symbols[s.seed]
        n = max(1, len(s.rec))
        head = groups(self.first)
        self.heads = self.first[head]
        group = np.repeat(np.arange(len(head), dtype=np.int64), np.diff(np.append(head, len(self.first))))
        self.n = n
        self.posted = np.sort(group * n + s.seed_of)  # by first symbol, then arrival

    def intervals(self, q: Titles, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix of the queries whether its first symbol is here, and the suffixes that begin with it."""
        v = symbols[q.seed]
        g = np.searchsorted(self.heads, v)
        here = np.flatnonzero((g < len(self.heads)) & (self.heads[np.minimum(g, len(self.heads) - 1)] == v)) if len(self.heads) else np.zeros(0, np.int64)
        return here, np.searchsorted(self.first, v[here], "left"), np.searchsorted(self.first, v[here], "right")

    def longest(self, q: Titles, symbols: np.ndarray, here: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first suffix of those that share most with each query suffix, by binary search a symbol deeper each time."""
        lo, hi = lo.copy(), hi.copy()
        begin, end = q.seed[here], q.ends()[q.seed_of[here]]
        own_end = self.ends[self.s.seed_of]
        alive, depth = np.arange(len(here)), 1
        while len(alive):
            alive = alive[(begin[alive] + depth < end[alive]) & (hi[alive] - lo[alive] > 1)]
            if not len(alive):
                break
            v = symbols[begin[alive] + depth]

            def bound(right: bool, alive=alive, v=v, depth=depth) -> np.ndarray:
                a, b = lo[alive].copy(), hi[alive].copy()
                while True:
                    live = a < b
                    if not live.any():
                        return a
                    m = (a + b) // 2
                    k = np.minimum(m, len(own_end) - 1)
                    place = self.s.seed[k] + depth
                    goes_on = place < own_end[k]
                    x = self.symbols[np.minimum(place, len(self.symbols) - 1)]
                    less = ~goes_on | (x <= v if right else x < v)
                    a, b = np.where(live & less, m + 1, a), np.where(live & ~less, m, b)

            left, right = bound(False), bound(True)
            some = left < right
            alive = alive[some]
            lo[alive], hi[alive] = left[some], right[some]
            depth += 1
        return lo

    def alike(self, q: Titles, most: int, near: int, share: tuple[int, int], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, record): for each query the most earliest records of this segment that it is like.

        before limits the records of each query to those that came before it. A query is like a record if their
        times are at most near apart and the words both have are share of all words of both.
        """
        symbols = q.symbols()
        here, lo, hi = self.intervals(q, symbols)
        got: list[np.ndarray] = []
        bound = np.full(len(q.rec), self.n, dtype=np.int64) if before is None else before.astype(np.int64)

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            """Keep what is alike of these pairs, and search no further than needed."""
            ok = (j < bound[i]) & (np.abs(q.at[i] - self.s.at[j]) <= near)
            a, b = q.size[i], self.s.size[j]
            ok &= np.minimum(a, b) * share[1] >= np.maximum(a, b) * share[0]
            pair = np.unique(i[ok] * self.n + j[ok])
            i, j = pair // self.n, pair % self.n
            both = shared_words(q, i, self.s, j)
            yes = both * share[1] >= share[0] * (q.size[i] + self.s.size[j] - both)
            if not yes.any():
                return
            got.append(pair[yes])
            every = np.unique(np.concatenate(got))
            got[:] = [every]
            head = groups(every // self.n)
            last = head + most - 1
            full = last < np.append(head[1:], len(every))
            i, j = np.divmod(every[last[full]], self.n)
            bound[i] = np.minimum(bound[i], j)

        if len(here):
            of = q.seed_of[here]
            if before is None:
                keep(of, self.s.seed_of[self.longest(q, symbols, here, lo, hi)])
            g = np.searchsorted(self.heads, self.first[lo]) * self.n
            at, stop = np.searchsorted(self.posted, g), np.searchsorted(self.posted, g + bound[of])
            width = 32
            live = np.flatnonzero(at < stop)
            while len(live):
                take = np.minimum(stop[live] - at[live], width)
                cut = np.searchsorted(np.cumsum(take), np.arange(0, int(take.sum()), 16 * TILE)[1:])
                for k in np.split(np.arange(len(live)), cut):
                    j = self.posted[ranges(at[live[k]], take[k])] - np.repeat(g[live[k]], take[k])
                    keep(np.repeat(of[live[k]], take[k]), j)
                at[live] += take
                stop[live] = np.minimum(stop[live], np.searchsorted(self.posted, g[live] + bound[of[live]]))
                live = live[at[live] < stop[live]]
                width = min(4 * width, 4 * TILE)
        pair = got[0] if got else np.zeros(0, np.int64)
        i, j = np.divmod(pair, self.n)
        head = groups(i)
        first_ones = np.arange(len(pair)) - np.repeat(head, np.diff(np.append(head, len(pair)))) < most
        return i[first_ones], j[first_ones]
