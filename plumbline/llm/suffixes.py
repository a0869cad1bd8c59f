"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are classified as larger or smaller than their right neighbour; substrings between
leftmost-smaller positions are sorted (by packed letters; where equal ones are very long, by
inducing), named, and sorted as a shorter text by the same function, or by doubling where that text
is short and steps would cost more than letters; one more pass of inducing gives the whole array. Inducing walks the buckets in order, as many at once as do not feed each other, so
each step is a vector operation.
"""

from __future__ import annotations

import numpy as np

#: Letters by which substrings are sorted with packed keys before inducing sorts them.
KEY_LETTERS = 112
#: Texts of names up to this length are sorted by doubling.
SHORT = 1 << 18


def _inside(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: place of each within its group."""
    count = np.arange(len(keys))
    if len(keys) < 4096:  # one look-up costs less than five passes
        return count - keys.searchsorted(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return count - np.repeat(first, np.diff(np.append(first, len(keys))))


class _Inducer:
    """Bucket-wise induced sorting of one text over the letters 0..letters-1."""

    def __init__(self, text: np.ndarray, letters: int):
        self.text, self.letters, n = text, letters, len(text)
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=letters))))
        rises = np.zeros(n, bool)
        rises[:-1] = text[:-1] < text[1:]
        differs = np.ones(n, bool)
        differs[:-1] = text[:-1] != text[1:]
        # In a run of equal letters all are like the run's last.
        last = np.flatnonzero(differs)
        self.smaller = np.repeat(rises[last], np.diff(np.concatenate(([-1], last))))
        marks = np.zeros(n, bool)
        marks[1:] = self.smaller[1:] & ~self.smaller[:-1]
        self.marks = marks
        self.leftmost = np.flatnonzero(marks)
        # Letter to the left of a place where that suffix is larger, or smaller; else -1, as at place -1.
        kind = np.int16 if letters <= 1 << 15 else np.int32
        self.before_larger, self.before_smaller = np.full(n + 1, -1, kind), np.full(n + 1, -1, kind)
        np.copyto(self.before_larger[1:n], text[:-1], where=~self.smaller[:-1], casting="unsafe")
        np.copyto(self.before_smaller[1:n], text[:-1], where=self.smaller[:-1], casting="unsafe")

    def run(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes, from leftmost-smaller ones in order (of letters at least)."""
        n = len(self.text)
        out = np.full(n, -1, np.int32)
        letter = self.text[leftmost]
        inside = _inside(letter)
        size = np.bincount(letter, minlength=self.letters)
        out[self.bounds[1:][letter] - size[letter] + inside] = leftmost
        self._larger(out)
        larger = self.bounds[:-1] + np.bincount(self.text[~self.smaller], minlength=self.letters)
        kept = np.zeros(n + 1, np.int32)  # clear what belongs to smaller suffixes
        np.add.at(kept, self.bounds[:-1], 1)
        np.add.at(kept, larger, -1)
        out[np.cumsum(kept[:-1]) == 0] = -1
        self._smaller(out)
        return out

    def _larger(self, out: np.ndarray) -> None:
        bounds, before = self.bounds, self.before_larger
        head = bounds[:-1].copy()
        end = len(self.text) - 1
        out[head[self.text[end]]] = end
        head[self.text[end]] += 1
        low, width = 0, 16
        while low < self.letters:
            high = min(self.letters, low + width)
            places = out[bounds[low] : bounds[high]]
            letter = before[places]
            keep = letter >= 0
            found = letter[keep]
            least = int(found.min()) if len(found) else self.letters
            if least >= high:
                width *= 2
            elif least > low:  # stop before the first bucket that is still being fed
                cut = bounds[least] - bounds[low]
                high, width = least, max(1, (least - low) * 2)
                places, keep = places[:cut], keep[:cut]
                found = letter[:cut][keep]
            else:  # the first bucket feeds itself
                high, width = low + 1, 2
                first = bounds[low]
                while first < head[low]:
                    part = out[first : head[low]]
                    first = head[low]
                    own = part[before[part] == low] - 1
                    out[first : first + len(own)] = own
                    head[low] += len(own)
                places = out[bounds[low] : bounds[high]]
                letter = before[places]
                keep = letter > low
                found = letter[keep]
            if len(found):
                source = places[keep] - 1
                order = found.argsort(kind="stable")
                letter = found[order]
                place = head[letter] + _inside(letter)
                out[place] = source[order]
                last = np.append(letter[1:] != letter[:-1], True)
                head[letter[last]] = place[last] + 1
            low = high

    def _smaller(self, out: np.ndarray) -> None:
        bounds, before = self.bounds, self.before_smaller
        tail = bounds[1:].copy()
        high, width = self.letters, 16
        while high > 0:
            low = max(0, high - width)
            places = out[bounds[low] : bounds[high]][::-1]
            letter = before[places]
            keep = letter >= 0
            found = letter[keep]
            most = int(found.max()) if len(found) else -1
            if most < low:
                width *= 2
            elif most < high - 1:
                low = most + 1
                cut = bounds[high] - bounds[low]
                width = max(1, (high - low) * 2)
                places, keep = places[:cut], keep[:cut]
                found = letter[:cut][keep]
            else:
                # Only the bucket's smaller suffixes feed it: equal neighbours are of one kind.
                low, width = high - 1, 2
                last = bounds[high]
                while last > tail[low]:
                    part = out[tail[low] : last][::-1]
                    last = tail[low]
                    own = part[before[part] == low] - 1
                    out[last - len(own) : last] = own[::-1]
                    tail[low] -= len(own)
                places = out[bounds[low] : bounds[high]][::-1]
                letter = before[places]
                keep = (letter >= 0) & (letter < low)
                found = letter[keep]
            if len(found):
                source = places[keep] - 1
                order = found.argsort(kind="stable")
                letter = found[order]
                place = tail[letter] - 1 - _inside(letter)
                out[place] = source[order]
                last = np.append(letter[1:] != letter[:-1], True)
                tail[letter[last]] = place[last]
            high = low

    def names(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the leftmost-smaller substrings in text order, equal for equal ones."""
        place = self.leftmost
        length = np.diff(np.append(place, len(self.text))) + 1
        length[-1:] = 0  # the last reaches the end: equal to no other
        of = np.zeros(len(self.text), np.int32)
        of[place] = np.arange(len(place))
        ranked = of[order]
        one, two = ranked[:-1], ranked[1:]
        same = (length[one] == length[two]) & (length[one] > 0)
        left = np.flatnonzero(same)
        a, b, todo = place[one[left]], place[two[left]], length[one[left]]
        at = 0
        while len(left):
            equal = self.text[a + at] == self.text[b + at]
            same[left[~equal]] = False
            at += 1
            go = equal & (todo > at)
            left, a, b, todo = left[go], a[go], b[go], todo[go]
        names = np.zeros(len(place), np.int32)
        names[ranked] = np.concatenate(([0], np.cumsum(~same)))
        return names, int(len(place) - same.sum())


def _split(before: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by rank and key: ranks that the keys tell apart, and how many rows share each."""
    group = np.concatenate(([True], before[1:] != before[:-1]))
    part = group.copy()
    part[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(part)
    size = np.diff(np.append(first, len(key)))
    first, size = np.repeat(first, size), np.repeat(size, size)
    return before + first - np.maximum.accumulate(np.where(group, np.arange(len(key)), 0)), size


def _keyed_names(text: np.ndarray, place: np.ndarray, letters: int) -> tuple[np.ndarray, int] | None:
    """Names of the leftmost-smaller substrings, sorted by as many letters at once as a key holds.

    A digit is 0 after the text, 1 and up for a letter and the largest after a substring: where one
    goes on and the other ends, its letter is followed by a larger suffix and sorts before. None if
    some equal substrings are too long for this.
    """
    end = letters + 1
    bits = end.bit_length()
    step = 64 // bits
    rounds = -(-KEY_LETTERS // step)
    length = np.diff(np.append(place, len(text))) + 1
    length[-1] = len(text) + KEY_LETTERS + 2 * step  # goes on past the end
    digits = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(1, np.uint64)))

    def keys(of: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(of), np.uint64)
        start, left = place[of] + at, length[of] - at
        for i in range(step):
            digit = digits[np.minimum(start + i, len(text))]
            digit[left <= i] = end
            out = (out << np.uint64(bits)) | digit
        return out

    rank = np.zeros(len(place), np.int64)  # how many substrings are smaller
    live, at = np.arange(len(place)), 0
    while len(live):
        if at >= step * rounds:
            return None
        key = keys(live, at)
        order = np.lexsort((key, rank[live])) if at else np.argsort(key)
        live, key = live[order], key[order]
        rank[live], size = _split(rank[live], key)
        at += step
        live = live[(size > 1) & (length[live] >= at)]
    seen = np.zeros(len(place), np.int32)
    seen[rank] = 1
    dense = np.cumsum(seen, dtype=np.int32)
    return dense[rank] - 1, int(dense[-1])


def _doubled(text: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array by doubling: suffixes that share some letters are told apart by as many after them."""
    n = len(text)
    bits = letters.bit_length()
    shared = min(n, 64 // bits)
    digits = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(shared, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(shared):
        key = (key << np.uint64(bits)) | digits[i : i + n]
    rank = np.zeros(n + 1, np.int64)  # how many suffixes are smaller; the empty one is before all
    rank[n] = -1
    live = np.argsort(key)
    rank[live], size = _split(np.zeros(n, np.int64), key[live])
    live = live[size > 1]
    while len(live):
        key = (rank[live] << 32) | (rank[np.minimum(live + shared, n)] + 1)
        by_key = np.argsort(key)
        live, key = live[by_key], key[by_key]
        rank[live], size = _split(key >> 32, key)
        live = live[size > 1]
        shared *= 2
    order = np.empty(n, np.int32)
    order[rank[:n]] = np.arange(n, dtype=np.int32)
    return order


def suffix_array(text: np.ndarray, letters: int = 256) -> np.ndarray:
    """Places of all suffixes in order; a suffix that ends sorts before one that goes on."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    inducer = _Inducer(text, letters)
    places = inducer.leftmost
    if len(places) > 1:
        named = _keyed_names(text, places, letters)
        if named is None:
            rough = places[np.argsort(text[places], kind="stable")]
            order = inducer.run(rough)
            named = inducer.names(order[inducer.marks[order]])
        names, kinds = named
        order = np.empty_like(places)
        if kinds < len(places):
            order = places[(_doubled if len(places) <= SHORT else suffix_array)(names, kinds)]
        else:
            order[names] = places
    else:
        order = places
    return inducer.run(order)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the suffix before it in order (-1: none), and the length both share.

    Only places where the letters to the left differ are compared; elsewhere the length is that of
    the place to the left less one.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    inner = (place > 0) & (before > 0)
    carried = inner.copy()
    carried[inner] = text[place[inner] - 1] == text[before[inner] - 1]
    # Carried only if the suffix before the left place is the left neighbour of the one before here.
    carried[inner] &= before[place[inner] - 1] == before[inner] - 1
    start = np.flatnonzero(~carried)
    shared = np.zeros(len(start), np.int64)
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    words = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    live = np.flatnonzero(before[start] >= 0)
    a, b = start[live], before[start[live]]
    while len(live):
        room = n - np.maximum(a, b)
        differ = words[a] ^ words[b]
        low = differ & (~differ + np.uint64(1))
        # The exponent of a power of two is the place of its bit.
        equal = ((low.astype(np.float64).view(np.int64) >> 52) - 1023) >> 3
        equal[differ == 0] = 8
        equal = np.minimum(equal, room)
        shared[live] += equal
        go = (equal == 8) & (room > 8)
        live, a, b = live[go], a[go] + 8, b[go] + 8
    out = np.zeros(n, np.int64)
    # out[i] = shared[start] - (i - start), with start the last compared place up to i
    size = np.diff(np.append(start, n))
    out[:] = np.repeat(shared, size) - (place - np.repeat(start, size))
    return before, np.maximum(out, 0)
