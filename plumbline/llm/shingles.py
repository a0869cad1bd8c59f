"""Sets of word shingles and what can be said of two of them without looking inside.

A set is the sorted distinct 64-bit hashes of a document's word shingles, lower case. Two sets
link when their intersection is at least a given share of their union. Unless a caller says
otherwise shingles have 3 words and the share is 90/100, as in op2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.llm.texts import Words, mix, ranges

SHINGLE = 3
#: Numerator and denominator of the least similarity.
LEAST = (90, 100)
#: Bits of the smallest bitmap; larger sets have the next power of two above their size.
BITMAP_BITS = 1024


def sets_of(offsets: np.ndarray, data: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk.

    A document of fewer words is one shingle as a whole; one without words has none.
    """
    words = Words(offsets, data, lower=True)
    place, hashes = words.grams(shingle)
    chain = words.chain()
    first = np.searchsorted(place, words.first)
    for doc in range(words.docs):
        if words.count[doc] >= shingle:
            yield np.unique(hashes[first[doc] : first[doc + 1]])
        elif words.count[doc]:
            yield ranges(chain, words.first[doc : doc + 1], words.first[doc + 1 : doc + 2])
        else:
            yield hashes[:0]


def set_hash(members: np.ndarray) -> int:
    """A hash of the whole set; 0 for the empty one."""
    if not len(members):
        return 0
    total = np.array([mix(members).sum(dtype=np.uint64) + np.uint64(len(members))])
    return int(mix(total).view(np.int64)[0])


def _level(smaller: int, share: tuple[int, int]) -> int:
    """Tiles of sets of this size, as a power of two: more than elements two linked sets differ in."""
    least, whole = share
    return (smaller * (whole - least) // least).bit_length()


#: Bits of ``spare`` that hold the number of tiles; the level lies above them.
SPARE_BITS = 25


def tile_keys(members: np.ndarray, share: tuple[int, int] = LEAST) -> np.ndarray:
    """Keys of the tiles a set lies in."""
    return tiles_of(members, share)[0]


def tiles_of(members: np.ndarray, share: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tiles a set lies in, and for each its level and how many of that level it can spare.

    The hash range is cut into equal parts, a quarter more than the elements in which two linked sets
    of this size band can differ; so two linked sets agree in all elements of some part, or in having
    none. If they agree in no other way, all parts that hold something differ, and so few can that
    nearly all are empty: only then empty parts have keys, and unrelated sets do not meet in them. A
    part's key is a hash of its elements. Sets whose band reaches into further powers of two lie in
    the tiles of each. Sets so small that linked ones are equal lie in none.

    Linked sets agree in at least as many parts as there are beyond those they can differ in. A set
    that leaves its most crowded tiles, one less than that, still meets every linked one: of the
    tiles a pair agrees in, the least crowded is dropped by neither, if both go by one order.
    """
    least, whole = share
    n = len(members)
    out, spare = [], []
    for level in range(max(1, _level(-(-n * least // whole), share)), _level(n, share) + 1):
        parts = ((5 << level) + 3) // 4
        part = ((members >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members), dtype=np.uint64)))
        edges = np.searchsorted(part, np.arange(parts + 1))
        content = sums[edges[1:]] - sums[edges[:-1]]
        keys = mix(content + mix(np.arange(parts, dtype=np.uint64) + np.uint64(2 << level)))
        full = edges[1:] > edges[:-1]
        apart = min((1 << level) - 1, n * (whole - least) // least)
        empty = int((~full).sum())
        if empty < parts - apart:
            keys = keys[full]
            more = parts - apart - empty - 1
        else:
            more = parts - apart - 1
        out.append(keys)
        spare.append(np.full(len(keys), (level << SPARE_BITS) + min(more, (1 << SPARE_BITS) - 1), np.int32))
    if not out:
        return members[:0], np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(spare)


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each bit, as whole numbers of 64 bits.

    Bits in which two bitmaps differ are at most as many as the elements the sets differ in.
    """
    bits = max(BITMAP_BITS, 1 << (len(members) - 1).bit_length()) if len(members) else BITMAP_BITS
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) brought to fewer words; parities of bits that fall together add up."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def overlap_possible(one, two, differ, share: tuple[int, int] = LEAST):
    """Can sets of these sizes link if they differ in at least ``differ`` elements?"""
    least, whole = share
    # overlap <= (one + two - differ) / 2, and the union is what is left of one + two
    return (whole + least) * (one + two - differ) >= 2 * least * (one + two)


def linked(one: np.ndarray, two: np.ndarray, share: tuple[int, int] = LEAST) -> bool:
    """The exact test, on sorted arrays."""
    least, whole = share
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    overlap = int((two[at] == one).sum()) if len(two) else 0
    return overlap > 0 and whole * overlap >= least * (len(one) + len(two) - overlap)
