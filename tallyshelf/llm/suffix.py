"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, and lookups across shards.

A shard is one byte array: pieces of text, each followed by BREAK, a byte that UTF-8 never uses. Every BREAK counts
as a symbol of its own, so a comparison ends with its piece and all suffixes differ.
"""

from __future__ import annotations

import numpy as np

BREAK = 0xFF
WORD = 8
BLOCK = 8  # words that are compared at once
STEPS = np.arange(0, WORD * BLOCK, WORD)


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, BREAK beyond the end."""
    longer = np.concatenate([data, np.full(WORD, BREAK, np.uint8)])
    return np.ndarray(len(data), ">u8", longer, strides=(1,)).astype(np.uint64)


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes from every position on, nothing but BREAK after the end of its piece, and the bytes to that end."""
    ends = np.flatnonzero(data == BREAK)
    room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(data))
    words, near = packed(data), np.flatnonzero(room < WORD)
    beyond = np.array([(1 << 8 * (WORD - k)) - 1 for k in range(WORD)], np.uint64)
    words[near] |= beyond[room[near]]
    return words, room


def _sorted_places(major: np.ndarray, minor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by two columns of numbers below 2**bits, and where a pair is not the one before it.

    Both and the index go into one number where they fit, since plain numbers sort many times faster than an
    order can be found.
    """
    new = np.ones(len(major), bool)
    if 3 * bits <= 63:
        keys = (major << 2 * bits) | (minor << bits) | np.arange(len(major))
        keys.sort()
        by = keys & ((1 << bits) - 1)
        keys >>= bits
        new[1:] = keys[1:] != keys[:-1]
        return by, new
    by = np.lexsort((minor, major))
    major, minor = major[by], minor[by]
    new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    return by, new


def suffix_array(words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and the place of each position.

    Sorted by a few bytes first; then only groups that are still undecided are sorted by the place of the suffix
    that begins where the compared part ends, which doubles that part.
    """
    n = len(words)
    bits = max(1, n.bit_length())
    done = 5 if bits <= 24 else WORD
    first = words >> np.uint64(8 * (WORD - done))
    if bits <= 24:
        order = (np.sort((first << np.uint64(bits)) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.argsort(first, kind="stable")
    # a suffix whose compared part holds the end of its piece is decided: ends follow their position
    fresh = np.ones(n, bool)
    ordered = first[order]
    fresh[1:] = (ordered[1:] != ordered[:-1]) | (room[order[1:]] < done)
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(at):
        positions = order[at]
        by, new = _sorted_places(place[positions], place[positions + done], bits)
        positions = positions[by]
        order[at] = positions
        place[positions] = np.maximum.accumulate(np.where(new, at, 0))
        # what now is alone in its group is decided
        at = at[~(new & np.append(new[1:], True))]
        done *= 2
    return order, place


def common_prefixes(order: np.ndarray, place: np.ndarray, words: np.ndarray, room: np.ndarray, stride: int = 16) -> np.ndarray:
    """By place: how many bytes a suffix shares with the one before it in the order.

    Kasai's walk through the positions, where each keeps all but one of the bytes its neighbour shared; stretches
    of positions are walked side by side. Bytes are compared eight at a time, and BLOCK times as many where these
    are alike.
    """
    n = len(order)
    words = np.append(words, np.zeros(BLOCK, np.uint64).repeat(WORD))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    starts = np.arange(0, n, stride)
    held = np.zeros(len(starts), np.int64)
    for step in range(min(stride, n)):
        i = starts + step
        if i[-1] >= n:
            starts, held, i = starts[:-1], held[:-1], i[:-1]
        j = before[i]
        most = np.where(j >= 0, np.minimum(room[i], room[j]), 0)
        length = np.minimum(np.maximum(held - 1, 0), most)
        active = np.flatnonzero(length < most)
        at, other = i[active] + length[active], j[active] + length[active]
        differ = words[at] ^ words[other]
        length[active] += _leading_bytes(differ)
        same = differ == 0
        active, at, other = active[same], at[same] + WORD, other[same] + WORD
        while len(active):
            differ = words[at[:, None] + STEPS] ^ words[other[:, None] + STEPS]
            word = np.argmax(differ != 0, axis=1)
            differ = differ[np.arange(len(active)), word]
            same = differ == 0
            length[active] += np.where(same, WORD * BLOCK, WORD * word + _leading_bytes(differ))
            same &= length[active] < most[active]
            active, at, other = active[same], at[same] + WORD * BLOCK, other[same] + WORD * BLOCK
        np.minimum(length, most, out=length)
        shared[i] = held = length
    return shared[order]


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the highest bytes are 0."""
    # without the bit below the highest, the number cannot be rounded up to a power of two
    exponent = (differ & ~(differ >> np.uint64(1))).astype(np.float64).view(np.int64) >> 52
    return np.where(differ == 0, WORD, (1023 + 63 - exponent) >> 3)


def repeated_starts(data: np.ndarray, identity: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, class of each, whether its class has several identities) of all strings of `length` bytes.

    `identity` names the place in the input that a position stands for; positions with one identity count once.
    """
    words, room = symbols(data)
    order, place = suffix_array(words, room)
    shared = common_prefixes(order, place, words, room)
    whole = room[order] >= length
    positions, classes = order[whole], np.cumsum(shared < length)[whole]
    names = identity[positions]
    # a class has several identities if its smallest differs from its largest
    new = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(classes) else np.zeros(0, np.int64)
    if not len(new):
        return positions, classes, np.zeros(0, bool)
    several = np.minimum.reduceat(names, new) != np.maximum.reduceat(names, new)
    return positions, classes, np.repeat(several, np.diff(np.append(new, len(classes))))


def found_elsewhere(first: np.ndarray, second: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the 128-bit fingerprints (two halves) of several shards also belong to another place, by binary search.

    The fingerprints of all shards are merged into one sorted run; each one then looks up the stretch of its equals.
    Two shards can hold the same place, which a text and a start name; that does not count.
    """
    order = np.lexsort((second, first))
    left, right = np.searchsorted(first[order], first, "left"), np.searchsorted(first[order], first, "right")
    found = np.zeros(len(first), bool)
    for k in range(int((right - left).max(initial=0))):
        at = order[np.minimum(left + k, len(first) - 1)]
        found |= (left + k < right) & (second[at] == second) & ((text[at] != text) | (start[at] != start))
    return found
