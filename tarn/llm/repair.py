"""Re-Pair grammar compression of token ids: frequent pairs of neighbours become nonterminals, again and again.

compress() works on one shard. A round counts the pairs of neighbours, takes those that occur `level` times or
more, and replaces them side by side: of two pairs that overlap the more frequent one wins, a run of one symbol
is paired from its left. The level falls from round to round by FALL down to LEAST, so that frequent pairs go
first, as in the one-pair-at-a-time form, and a shard takes some ten passes of NumPy instead of one for each
rule. A replacement that would be made fewer than LEAST times isn't made, and it ends with a round at LEAST that
makes the sequence shorter by less than one part in GAIN. Pairs never cross the end of a
document, so each document is a range of the final sequence.

A grammar is the terminals (the ids in use, dense symbols 0, 1, ...), the rules (symbol len(terminals) + i is the
pair rules[i], both sides smaller) and the length of each symbol's expansion. expand() writes out any range of the
sequence; token() and window() find single ids of a document by prefix sums over those lengths, without
expanding what lies before.
"""

from dataclasses import dataclass

import numpy as np

from tarn.llm.bytescan import spread

LEAST, FALL, TOP, GAIN = 8, 4, 1 << 14, 64
_BUCKETS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    terminals: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, ids): the expansion of symbol s is ids[place[s]:place[s] + lengths[s]]. Each rule copies its sides, which come before."""
        place = np.cumsum(self.lengths) - self.lengths
        n = len(self.terminals)
        ids = np.empty(int(self.lengths.sum()), np.uint32)
        ids[:n] = self.terminals
        depth = np.zeros(n + len(self.rules), np.int32)
        for at, (a, b) in enumerate(self.rules.tolist(), n):
            depth[at] = max(depth[a], depth[b]) + 1
        for d in range(1, int(depth.max(initial=0)) + 1):
            s = np.flatnonzero(depth == d)
            a, b = self.rules[s - n].T
            ids[spread(place[s], self.lengths[a])] = ids[spread(place[a], self.lengths[a])]
            ids[spread(place[s] + self.lengths[a], self.lengths[b])] = ids[spread(place[b], self.lengths[b])]
        return place, ids


def _pairs(seq: np.ndarray, last: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the left sides of frequent pairs, number of the pair at each place, counts by number), the most frequent pair first."""
    counts = np.bincount(seq)
    often = counts >= level
    left = often[seq]
    at = np.flatnonzero(left[:-1] & left[1:] & ~last[:-1])
    keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1].astype(np.uint64)
    bucket = ((keys * _MIX) >> np.uint64(64 - _BUCKETS)).astype(np.int64)
    fits = (np.bincount(bucket, minlength=1 << _BUCKETS) >= level)[bucket]
    at, keys = at[fits], keys[fits]
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(keys)))
    place = np.full(len(n), -1)
    ranked = np.lexsort((ordered[first], -n))
    ranked = ranked[: int((n >= level).sum())]
    place[ranked] = np.arange(len(ranked))
    number = np.empty(len(keys), np.int64)
    number[order] = place[np.cumsum(new) - 1]
    keep = number >= 0
    return at[keep], number[keep], n[ranked]


def _chosen(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which places to replace so that no two overlap: a place yields to a neighbour of smaller number; of equal ones in a row every other goes."""
    close = np.diff(at) == 1
    far = np.iinfo(np.int64).max
    before, after = np.full(len(at), far), np.full(len(at), far)
    before[1:][close] = number[:-1][close]
    after[:-1][close] = number[1:][close]
    starts = before != number
    run = np.flatnonzero(starts)
    size = np.diff(np.append(run, len(at)))
    offset = np.arange(len(at)) - np.repeat(run, size)
    return (np.repeat(before[run] > number[run], size)) & (offset % 2 == 0) & (after >= number)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, fall: int = FALL, gain: int = GAIN) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """(grammar, sequence, ends in the sequence) of the ids of several documents; ends: where each document ends."""
    terminals, seq = _dense(ids)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules, lengths, n = [np.zeros((0, 2), np.int64)], [np.ones(len(terminals), np.int64)], len(terminals)
    level = max(least, min(TOP, 1 << max(len(seq) // 64, 1).bit_length()))
    while len(seq) > 1:
        size = len(seq)
        at, number, counts = _pairs(seq, last, level)
        chosen = _chosen(at, number) if len(at) else np.zeros(0, bool)
        used = np.bincount(number[chosen], minlength=len(counts)) >= least
        chosen &= used[number]
        if chosen.any():
            places, symbol = at[chosen], (np.cumsum(used) - 1)[number[chosen]]
            sides = np.empty((int(used.sum()), 2), np.int64)
            sides[symbol, 0], sides[symbol, 1] = seq[places], seq[places + 1]
            known = np.concatenate(lengths)
            rules.append(sides)
            lengths.append(known[sides].sum(axis=1))
            seq[places] = n + symbol
            n += len(sides)
            last[places] = last[places + 1]
            stay = np.ones(len(seq), bool)
            stay[places + 1] = False
            seq, last = seq[stay], last[stay]
        if level == least and (size - len(seq)) * gain < size:
            break
        level = max(least, level // fall)
    sizes = np.diff(ends, prepend=0) > 0
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[sizes] = np.flatnonzero(last) + 1
    return Grammar(terminals, np.concatenate(rules), np.concatenate(lengths)), seq, np.maximum.accumulate(new_ends) if len(ends) else new_ends


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    used = np.zeros(int(ids.max()) + 1, bool)
    used[ids] = True
    return np.flatnonzero(used).astype(np.uint32), (np.cumsum(used) - 1)[ids]


def expand(grammar: Grammar, symbols: np.ndarray, flat: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids that the symbols stand for."""
    place, ids = flat or grammar.flat()
    return ids[spread(place[symbols], grammar.lengths[symbols])]


def token(grammar: Grammar, symbols: np.ndarray, i: int) -> int:
    """Id i of a document, walking down the rules of the one symbol that covers it."""
    ends = np.cumsum(grammar.lengths[symbols])
    if not 0 <= i < (int(ends[-1]) if len(ends) else 0):
        raise IndexError(i)
    k = int(np.searchsorted(ends, i, "right"))
    s, i = int(symbols[k]), i - int(ends[k] - grammar.lengths[symbols[k]])
    n = len(grammar.terminals)
    while s >= n:
        a, b = grammar.rules[s - n].tolist()
        size = int(grammar.lengths[a])
        s, i = (a, i) if i < size else (b, i - size)
    return int(grammar.terminals[s])


def window(grammar: Grammar, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 of a document; only symbols that reach into the range are expanded."""
    ends = np.cumsum(grammar.lengths[symbols])
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right"))
    before = int(ends[a] - grammar.lengths[symbols[a]])
    return expand(grammar, symbols[a : b + 1])[start - before : stop - before]
