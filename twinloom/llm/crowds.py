"""Similar members of a crowd: sets that a band brought together though not all are alike.

A crowd is split by the tokens of its members, ordered by how many members of this very crowd have
them. What all members share says nothing, so it comes last. Two sets whose first common token, in
that order, is among what all share have a similarity that follows from their sizes alone: if it
suffices, both are similar to the smallest member, and one star links them all. Every other similar pair
has a rarer token in common, among the first of both, by the usual prefix bound. For each such token
there is a smaller crowd of those that have it; one that lies inside another which is done is skipped.

Members are labelled: those of one label are connected already. A crowd of one label is done. Crowds of up to
some thousand members are compared pair by pair, by sketches first, as are larger ones whose smaller
crowds overlap so much that they have more pairs. No similar pair is left unconnected.
"""

from __future__ import annotations

from math import ceil

import numpy as np

# Rounding of shares of set sizes.
SLACK = 1e-9
# Crowds up to this size are compared pair by pair in any case: splitting them would take longer.
DIRECT = 8192
# Pairs of members that are compared at once.
PAIRS_AT_ONCE = 1 << 18
# Sketches have from 2 to the 8th to 2 to the 13th bits.
WIDTHS = (8, 13)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def least_shared(size: np.ndarray | int, similar: float) -> np.ndarray | int:
    """Tokens that a set has in common with any similar one, at least."""
    return np.ceil(similar * size - SLACK).astype(np.int64) if isinstance(size, np.ndarray) else ceil(similar * size - SLACK)


def differing(similar: float) -> float:
    """The share of the sum of two similar sets' sizes that differs, at most."""
    return (1 - similar) / (1 + similar)


class Labels:
    """Which members are connected, as a forest."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two members; false if they were."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def all_one(self, members: np.ndarray) -> bool:
        first = self.root(int(members[0]))
        return all(self.root(int(m)) == first for m in members[1:])


def sketches(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A column for each set: parities of its tokens by hash, about as many as a set has tokens on average.

    Two sets differ in at least as many tokens as their sketches in bits.
    """
    width = int(np.clip(int(lengths.mean()).bit_length(), *WIDTHS))
    place = (flat.view(np.uint64) * _SPREAD) >> np.uint64(64 - width)
    at = np.repeat(np.arange(len(lengths)) << width, lengths) + place.view(np.int64)
    odd = (np.bincount(at, minlength=len(lengths) << width) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(odd.reshape(len(lengths), -1), axis=1).view(np.uint64).T)


def _compared(
    members: np.ndarray, rest: list[np.ndarray], sizes: np.ndarray, labels: Labels, similar: float, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links among members whose pairs are all looked at, those that are connected already left out.

    With ``side`` given, only pairs of different sides are. Pairs whose sketches differ too much for similar sets are compared no further; the rest are counted exactly.
    """
    members, rest = np.asarray(members), list(rest)
    by_size = np.argsort(sizes[members], kind="stable")
    members, rest = members[by_size], [rest[k] for k in by_size]
    size, lengths = sizes[members], np.array([len(r) for r in rest])
    begin = np.cumsum(lengths) - lengths
    flat = np.concatenate(rest)
    sketch = sketches(flat, lengths)
    distinct, token = np.unique(flat, return_inverse=True)
    has = np.zeros(len(distinct), dtype=bool)
    alone = size - lengths - differing(similar) * size - SLACK
    group = np.array([labels.root(int(m)) for m in members])
    side = None if side is None else side[members]
    # Sets are ordered by size: behind these all are too large.
    reach = np.searchsorted(size, size / similar + SLACK, side="right")
    links = []
    rows = max(PAIRS_AT_ONCE // len(members), 1)
    for start in range(0, len(members), rows):
        block, to = slice(start, start + rows), reach[start : start + rows].max()
        bits = np.zeros((len(size[block]), to - start), dtype=np.int32)
        for word in sketch:
            bits += np.bitwise_count(word[block, None] ^ word[None, start:to])
        near = bits + alone[block, None] <= -alone[None, start:to]
        near &= group[block, None] != group[None, start:to]
        if side is not None:
            near &= side[block, None] != side[None, start:to]
        near = np.triu(near, 1)
        for own in np.flatnonzero(near.any(axis=1)) + start:
            others = np.flatnonzero(near[own - start]) + start
            others = others[group[others] != group[own]]
            ends = np.cumsum(lengths[others])
            at = np.arange(lengths[others].sum()) + np.repeat(begin[others] - ends + lengths[others], lengths[others])
            mine = token[begin[own] : begin[own] + lengths[own]]
            has[mine] = True
            found = np.append(0, np.cumsum(has[token[at]]))
            has[mine] = False
            shared = found[ends] - found[ends - lengths[others]]
            alike = others[shared >= similar * (size[own] + size[others] - shared) - SLACK]
            joined, first = np.unique(group[alike], return_index=True)
            links += [(int(members[own]), int(members[k])) for k in alike[first]]
            group[np.isin(group, joined)] = group[own]
    for i, j in links:
        labels.join(i, j)
    return links


def cross_links(
    sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similar: float, size: np.ndarray
) -> list[tuple[int, int]]:
    """Pairs of indices as of ``crowd_links``, for similar sets of different sides only."""
    return _compared(np.arange(len(sets)), sets, size, Labels(label), similar, side)


def _bits(members: np.ndarray, total: int) -> int:
    held = np.zeros(total, dtype=bool)
    held[members] = True
    return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")


def crowd_links(
    sets: list[np.ndarray], label: np.ndarray, similar: float, pairwise: int, size: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Pairs of indices of similar sets that, with the labels, connect all that are similar.

    A set is an array of distinct tokens. With ``size`` given, sets have so many tokens, of which those
    that are not listed are in common with no other member.
    """
    labels, links = Labels(label), []
    size = np.array([len(s) for s in sets]) if size is None else size
    done: list[int] = []
    # A crowd to be worked on, or the bits of one whose smaller crowds are all done.
    waiting: list[np.ndarray | int] = [np.arange(len(sets))]
    while waiting:
        members = waiting.pop()
        if isinstance(members, int):
            done = [members, *(d for d in done if d & ~members)]
            continue
        bits = _bits(members, len(sets))
        if labels.all_one(members) or any(bits & ~d == 0 for d in done):
            continue
        waiting.append(bits)
        rest, own = [sets[m] for m in members], size[members]
        if len(members) <= max(pairwise, DIRECT, 2):
            links += _compared(members, rest, size, labels, similar)
            continue
        lengths = np.array([len(r) for r in rest])
        flat, owner = np.concatenate(rest), np.repeat(np.arange(len(members)), lengths)
        _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = int((count == len(members)).sum())
        lead = int(own.argmin())
        star = np.flatnonzero(shared >= similar * (own + own[lead] - shared) - SLACK)
        links += [(int(members[lead]), int(members[k])) for k in star if labels.join(int(members[lead]), int(members[k]))]
        if labels.all_one(members):
            continue
        order = np.lexsort((of, count[of], owner))
        of = of[order]
        place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = lengths - least_shared(own, similar) + 1
        chosen = np.flatnonzero((place < first[owner]) & (count[of] > 1) & (count[of] < len(members)))
        chosen = chosen[np.lexsort((owner[chosen], of[chosen]))]
        parts = np.split(owner[chosen], np.flatnonzero(np.diff(of[chosen])) + 1)
        smaller = {who.tobytes(): members[who] for who in parts if len(who) > 1}
        if sum(len(who) ** 2 for who in smaller.values()) >= len(members) ** 2:
            # Smaller crowds that overlap have more pairs in all than this one.
            links += _compared(members, rest, size, labels, similar)
            continue
        # The largest are worked on first: what lies inside one of them needs no work then.
        waiting += sorted(smaller.values(), key=len)
    return links
