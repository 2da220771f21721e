"""Set similarity inside one group of sets by set relations: blocks of index lists skipped by size
and position, and a set's answers derived from those of a highly similar one.

Every shingle of the group has a list of the sets that hold it, ordered by set size and cut in
blocks; a block knows its range of sizes and the most shingles that can follow in one of its sets.
A *leader* probes the lists of its first shingles, skips each block in which no set could reach
the overlap less a slack, and gets the exact overlap with every set that is left. A set that is
similar enough to the leader (what it lacks or has more is covered by the slack) is a *follower*:
only the leader's answers can be its own, and its overlaps with them are the leader's, changed
along the lists of the few shingles that the two don't share. Sets are taken in an order in which
similar ones follow each other.

What comes back is a forest: of all links the ones that join two components. A group whose sets
are in one component needs no further look.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of size n that link share one of their first so many shingles."""
    return n - -(-percent * n // 100) + 1


def least_overlap(na, nb, percent: int):
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Group:
    """Sets of one group: class keys, whole sizes, shingles that no other class has, the other
    shingles in global order one set after the other, component labels, and sides (0: only in the
    lists, 1: only asks, 2: both)."""

    key: np.ndarray
    n: np.ndarray
    own: np.ndarray
    shared: list[np.ndarray]
    label: np.ndarray
    side: np.ndarray


class _Index:
    """Lists of a group's shingles, with their blocks."""

    def __init__(self, g: Group):
        order = np.lexsort((g.key, g.n))
        self.key, self.n, self.side = g.key[order], g.n[order], g.side[order]
        self.label = np.unique(g.label[order], return_inverse=True)[1]
        sets = [g.shared[i] for i in order]
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        own = g.own[order]
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        pos = ranges(own, self.size)
        in_lists = self.side[owner] != 1
        token, at = np.unique(flat, return_inverse=True)
        count = np.bincount(at[in_lists], minlength=len(token))
        self.token = at  # of each set, by start and size
        self.pos = pos
        entry = np.flatnonzero(in_lists)
        entry = entry[np.argsort(at[entry], kind="stable")]  # by shingle, then size
        self.member = owner[entry]
        self.count, self.first = count, np.cumsum(count) - count
        # blocks of up to BLOCK entries
        self.blocks = -(-count // BLOCK)
        self.first_block = np.cumsum(self.blocks) - self.blocks
        self.edge = ranges(np.zeros(len(token), np.int64), self.blocks) * BLOCK + np.repeat(self.first, self.blocks)
        self.block_size = np.minimum(self.edge + BLOCK, np.repeat(self.first + count, self.blocks)) - self.edge
        room = self.n[self.member] - pos[entry]
        self.low = self.n[self.member[self.edge]]
        self.high = self.n[self.member[self.edge + self.block_size - 1]]
        self.room = np.maximum.reduceat(room, self.edge) if len(self.edge) else room

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.start[i] : self.start[i] + self.size[i]]

    def members(self, tokens: np.ndarray) -> np.ndarray:
        """All entries of the lists of some shingles."""
        return self.member[ranges(self.first[tokens], self.count[tokens])]

    def reached(self, i: int, slack: int, percent: int) -> np.ndarray:
        """Sets that can have set i's least overlap less the slack; blocks that can't are skipped."""
        n = int(self.n[i])
        smallest = max(1, -(-(percent * n - (100 + percent) * slack) // 100))  # size of a set that can
        pos = self.pos[self.start[i] : self.start[i] + self.size[i]]
        ask = n - pos >= smallest
        token, left = self.tokens(i)[ask], (n - pos)[ask]
        blocks = self.blocks[token]
        b = ranges(self.first_block[token], blocks)
        most = np.minimum(np.repeat(left, blocks), self.room[b])
        b = b[(self.high[b] >= smallest) & (most >= least_overlap(n, self.low[b], percent) - slack)]
        return np.unique(self.member[ranges(self.edge[b], self.block_size[b])])


def _similar_first(x: _Index, asks: np.ndarray) -> np.ndarray:
    """The sets that ask, in an order in which similar ones follow each other: by their smallest hashes."""
    starts, some = x.start[asks], x.size[asks] > 0
    asks, starts = asks[some], starts[some]
    at = ranges(starts, x.size[asks])
    cuts = np.cumsum(x.size[asks]) - x.size[asks]
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        mixed = (x.token[at].astype(np.uint64) + np.uint64(1)) * np.uint64(salt)
        mixed ^= mixed >> np.uint64(29)
        keys.append(np.minimum.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), cuts) if len(at) else np.zeros(0, np.uint64))
    return asks[np.lexsort(keys)]


def links(g: Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links (a, b) between classes of the group whose labels differ."""
    found_a: list[int] = []
    found_b: list[int] = []
    parts = len(np.unique(g.label))
    if parts > 1 and any(len(s) for s in g.shared):
        x = _Index(g)
        label = x.label
        held = np.zeros(len(x.count), bool)  # the leader's shingles
        mine = np.zeros(len(x.count), bool)
        leader, slack, answers, overlap = -1, 0, None, None
        for i in _similar_first(x, np.flatnonzero(x.side != 0)):
            tokens, n = x.tokens(i), int(x.n[i])
            follows = False
            if leader >= 0:
                more = tokens[~held[tokens]]
                both = len(tokens) - len(more)
                grown = int((x.count[more] > 0).sum())  # what i has and the leader lacks
                shrunk = int(x.n[leader]) - n
                follows = slack >= grown + max(0, -(-percent * shrunk // (100 + percent)))
            if follows:
                mine[tokens] = True
                old = x.tokens(leader)
                fewer = old[~mine[old]] if both < len(old) else old[:0]
                mine[tokens] = False
                change = np.bincount(x.members(more), minlength=len(x.n)) - np.bincount(x.members(fewer), minlength=len(x.n))
                now = overlap + change[answers]
            else:
                if leader >= 0:
                    held[x.tokens(leader)] = False
                held[tokens] = True
                leader, slack = i, n // 4 + 1
                answers = x.reached(i, slack, percent)
                at = ranges(x.start[answers], x.size[answers])
                overlap = np.add.reduceat(held[x.token[at]], np.cumsum(x.size[answers]) - x.size[answers], dtype=np.int64) if len(at) else np.zeros(0, np.int64)
                keep = overlap >= least_overlap(n, x.n[answers], percent) - slack
                answers, overlap = answers[keep], overlap[keep]
                now = overlap
            linked = answers[(now >= least_overlap(n, x.n[answers], percent)) & (label[answers] != label[i])]
            if len(linked):
                new, first = np.unique(label[linked], return_index=True)
                found_a += [int(x.key[i])] * len(new)
                found_b += x.key[linked[first]].tolist()
                label[np.isin(label, new)] = label[i]
                parts -= len(new)
                if parts == 1:
                    break
    return np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)
