"""Removal of repeated lines, also fuzzy ones, across and within documents.

1. Lines are normalised, and equal ones become one class.  A class is sketched
   by the least hashes of its character grams in SLOTS slots of the hash
   space; bands of these are join keys, so lines that share most of their
   grams are likely to share a key.
2. The SimHash of a class has a bit set if more of those hashes have it than
   not.  Lines that share a key and whose SimHashes are within RADIUS bits are
   likely pairs.  The pigeonhole blocks of a SimHash find pairs within a few
   bits of each other alone, which an edited word already exceeds; so the
   bands find pairs and the SimHash rules pairs out.
3. Connected likely pairs form neighbourhoods.  Their texts are read once, and
   within each all pairs are verified by edit similarity.  In a large corpus
   chance chains tie very many unlike lines together; a neighbourhood beyond
   NEIGHBOURS lines is parted by the bands again, and verified within each.
4. Of each connected group of verified links the first occurrence, by doc_id
   and line number, stays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.groups import TEXT_BLOCK, Group, Links, compare_in_blocks, components, key_sizes, one_by_one
from halyard.llm.shared import KeyFilter, bounded_batches, free, join_hot, settled, table, tidy

#: Characters of a gram, bands of a line, parts of a band and slots of a part; the SimHash has 128 bits.
#: Grams of eight are rare in unlike lines, so few of these share three of a band.
GRAM, BANDS, BAND_PARTS, FINE = 8, 8, 3, 2
SLOTS = BANDS * BAND_PARTS * FINE
RADIUS = 44
#: A-Z are lower-cased, digits all read 0, ASCII white space parts words and other ASCII goes; a line ends at \n alone.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if 9 <= c <= 13 and c != 10 else c for c in range(256))
_DROPPED = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 32 or 9 <= c <= 13))
_NONE = np.uint32(0xFFFFFFFF)
#: For each byte a number with a byte for each of its bits: sums of up to 255 of these count set bits.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, :, None] * np.array([0] * 7 + [1], np.uint8), axis=2).reshape(256, 8).view(np.uint64).ravel()


def normalised(text: str | None) -> list[bytes]:
    """The lines of a text, as words parted by single spaces; empty for a line without letters or digits."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL, _DROPPED)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return [line.strip(b" ") for line in data.split(b"\n")]


def slots(lines: list[bytes]) -> np.ndarray:
    """A row of SLOTS numbers for each line: the least hash of its grams in each slot of the hash space, _NONE in an empty one."""
    out = np.full((len(lines), SLOTS), _NONE, np.uint32)
    margin = b" " * (GRAM - 1)
    first, size = 0, 0
    for last, line in enumerate(lines, 1):
        size += len(line) + GRAM - 1
        if size < 1 << 16 and last < len(lines):  # what the cache holds at a time
            continue
        part = lines[first:last]
        data = np.frombuffer(margin + margin.join(part) + margin, np.uint8).astype(np.uint64)
        n = len(data) - GRAM + 1
        grams = data[:n].copy()
        for i in range(1, GRAM):
            grams <<= np.uint64(8)
            grams |= data[i : n + i]
        grams = hashing.mix(grams)
        where = (grams >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)
        sizes = np.array([len(x) + GRAM - 1 for x in part])
        sizes[-1] += n - sizes.sum()
        where += np.repeat(np.arange(len(part), dtype=np.uint64) * np.uint64(SLOTS), sizes)
        np.minimum.at(out[first:last].reshape(-1), where.view(np.int64), grams.astype(np.uint32))
        first, size = last, 0
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A row of BANDS 64-bit keys for each row of slots; a part without grams borrows from the next that has some."""
    parts = found.reshape(len(found), BANDS * BAND_PARTS, FINE).min(axis=2)
    for step in range(1, BANDS * BAND_PARTS):
        empty = parts == _NONE
        if not empty.any():
            break
        # Another number for each step, so that what comes from afar does not look like its owner's.
        following = np.roll(parts, -1, axis=1)
        parts = np.where(empty & (following != _NONE), following * np.uint32(2 * step + 1) & np.uint32(0xFFFFFFFE), parts)
    mixed = hashing.mix(parts.astype(np.uint64) + (np.arange(BANDS * BAND_PARTS, dtype=np.uint64) << np.uint64(32)))
    return hashing.mix(mixed.reshape(len(parts), BANDS, BAND_PARTS).sum(axis=2, dtype=np.uint64)).view(np.int64)


def simhashes(found: np.ndarray) -> np.ndarray:
    """A row of two 64-bit numbers for each row of slots: a bit is set if more of the row's hashes have it than not."""
    out = np.empty((len(found), 2), np.uint64)
    for at in range(0, len(found), 500):  # what the cache holds at a time
        part = found[at : at + 500]
        one = hashing.mix(part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        both = np.stack([one, hashing.mix(one)], axis=2)
        filled = part != _NONE
        both[~filled] = 0
        counts = _SPREAD[both.view(np.uint8)].sum(axis=1, dtype=np.uint64).view(np.uint8)  # SLOTS is under 256
        out[at : at + 500] = np.packbits(2 * counts.reshape(len(part), 128).astype(np.int16) > filled.sum(axis=1)[:, None], axis=1).view(np.uint64)
    return out


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] agrees, a[:high] does not
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


#: Texts beyond this are compared by diagonals, in time of the distance squared and not of the length squared,
#: if they share enough grams of SHORT characters.
_LONG, SHORT = 6000, 5


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance; any number above ``most`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    at = _common(a, b)
    a, b = a[at:], b[at:]
    at = _common(a[::-1], b[::-1])
    a, b = (a[:-at], b[:-at]) if at else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    if len(a) > _LONG:
        return _by_diagonals(a, b, most)
    return _by_bits(a, b, most)


def _by_bits(a: str, b: str, most: int) -> int:
    """Myers' bit vectors, one bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in enumerate(b):
        x = where.get(c, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), plus & d
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - left - 1) > most:
            return most + 1
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        plus, minus = down | (full & ~(d | up)), up & d
    return score


def _grams_apart(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether texts share too few character grams to be within ``most`` edits: each edit spoils SHORT at most."""
    counts = []
    for t in (x, y):
        g = np.zeros(len(t) - SHORT + 1, np.uint64)
        for i in range(SHORT):
            g = hashing.mix(g + t[i : len(g) + i].view(np.uint64))
        counts.append(np.unique(g, return_counts=True))
    (gx, nx), (gy, ny) = counts
    _, i, j = np.intersect1d(gx, gy, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum()) < len(y) - SHORT + 1 - most * SHORT


def _by_diagonals(a: str, b: str, most: int) -> int:
    """Furthest reach on each diagonal for 0, 1, ... edits; ``a`` is no longer than ``b``."""
    x, y = _points(a), _points(b)
    if _grams_apart(x, y, most):
        return most + 1
    m, n = len(x), len(y)
    goal = n - m
    reach, first = np.empty(0, np.int64), 0  # reach[i] is the end in a on diagonal first + i
    for edits in range(most + 1):
        low, high = max(-edits, -m), min(edits, n)
        k = np.arange(low, high + 1)
        if edits == 0:
            at = np.zeros(1, np.int64)
        else:
            wide = np.full(high - low + 5, -2, np.int64)  # diagonals low - 2 to high + 2
            wide[first - low + 2 : first - low + 2 + len(reach)] = reach
            at = np.maximum(np.maximum(wide[1:-3], wide[2:-2] + 1), wide[3:-1] + 1)
        limit = np.minimum(m, n - k)
        at = np.minimum(at, limit)
        active = np.flatnonzero((at >= 0) & (at < limit) & (at + k >= 0))
        for _ in range(16):
            active = active[x[at[active]] == y[at[active] + k[active]]]
            at[active] += 1
            active = active[at[active] < limit[active]]
            if not len(active):
                break
        for i in active.tolist():  # few run on
            begin, end = int(at[i]), int(limit[i])
            at[i] += _common(a[begin:end], b[begin + int(k[i]) : end + int(k[i])])
        if low <= goal <= high and at[goal - low] >= m:
            return edits
        reach, first = at, low
    return most + 1


#: Characters that must agree for two texts to count as back in step.
_STEP = 12


def _aligned(a: str, b: str, limit: int) -> int | None:
    """Edits between ``a`` and ``b`` if runs that they share stay as they are; over ``limit`` it stops; None if they fall out of step.

    This many edits do.  Fewer may do only where it pays to break up a run of
    _STEP characters.
    """
    i = j = cost = 0
    while cost <= limit:
        same = _common(a[i:], b[j:])
        i, j = i + same, j + same
        left = max(len(a) - i, len(b) - j)
        reach = limit - cost + _STEP
        for skip in range(0, min(reach, len(a) - i - _STEP), 4):
            at = b.find(a[i + skip : i + skip + _STEP], j, j + skip + reach)
            if at >= 0:
                cost += edit_distance(a[i : i + skip], b[j:at], limit)
                i, j = i + skip, at
                break
        else:
            return cost + edit_distance(a[i:], b[j:], limit) if left <= 2 * reach else None
    return cost


def _shown(a: str, b: str, percent: int) -> bool:
    """Whether an alignment shows that two texts are similar."""
    most = max(len(a), len(b)) * (100 - percent) // 100
    if abs(len(a) - len(b)) > most:
        return False
    edits = _aligned(a, b, most)
    return edits is not None and edits <= most


def similar(a: str, b: str, percent: int) -> bool:
    """100 * (longer - distance) >= percent * longer, for texts of any length: what no alignment shows the distance itself settles."""
    most = max(len(a), len(b)) * (100 - percent) // 100
    return _shown(a, b, percent) or edit_distance(a, b, most) <= most


#: Pieces of texts that are met at a time, a lane of 64 bits each, and kinds of characters: space, a-z, 0 and four of others.
_LANES, _KINDS = 4096, 32
_KIND = np.array([(28 + c % 4, 0, 27, c - 96)[1 * (c == 32) + 2 * (c == 48) + 3 * (97 <= c <= 122)] for c in range(128)], np.uint8)


def _kinds(text: str) -> np.ndarray:
    """The kind of each character; equal characters are of one kind."""
    if text.isascii():
        return _KIND[np.frombuffer(text.encode(), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _KIND[points & 127], 28 + points % 4).astype(np.uint8)


def _least_edits(flat: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray, width: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each piece flat[at : at + size], of up to 64, its least distance to a part of flat[begin : begin + width].

    The part starts at its begin where ``head`` is set and ends at its end
    where ``tail`` is.

    Myers' bit vectors, many at a time.  Bits beyond a piece's size are never
    read, as carries go upwards only.
    """
    out = np.empty(len(at), np.int64)
    order = np.argsort(-width, kind="stable")
    one = np.uint64(1)
    for first in range(0, len(order), _LANES):
        lanes = order[first : first + _LANES]
        base, start, ends = np.arange(len(lanes)) * _KINDS, begin[lanes], width[lanes]
        masks = np.zeros(len(lanes) * _KINDS, np.uint64)
        for bit in range(int(size[lanes].max())):
            masks[base + flat[at[lanes] + bit]] |= np.uint64(1 << bit)
        score, top = size[lanes], (size[lanes] - 1).astype(np.uint64)
        best, first_up = score.copy(), head[lanes].astype(np.uint64)
        plus, minus = np.full(len(lanes), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(lanes), np.uint64)
        live = len(lanes)
        for column in range(int(ends[0])):
            if ends[live - 1] <= column:  # the widest come first
                now = int(np.searchsorted(-ends, -column))
                out[lanes[now:live]] = np.where(tail[lanes[now:live]], score[now:], best[now:])
                live = now
                base, start, score, best, top, first_up, plus, minus = (x[:live] for x in (base, start, score, best, top, first_up, plus, minus))
            same = masks.take(base + flat.take(start + column))
            x = same | minus
            d = same & plus
            d += plus
            d ^= plus
            d |= same
            down = plus & d
            d |= plus
            up = minus | ~d
            score += ((up >> top & one) - (down >> top & one)).view(np.int64)
            np.minimum(best, score, out=best)
            up <<= one
            up |= first_up
            down <<= one
            plus = x | up
            np.invert(plus, out=plus)
            plus |= down
            minus = up & x
        out[lanes[:live]] = np.where(tail[lanes[:live]], score, best)
    return out


def _maybe(pairs: list[tuple[np.ndarray, np.ndarray]], percent: int) -> np.ndarray:
    """Which pairs of kinds of characters may be similar; those left out are not.

    The shorter text is cut into pieces.  Within the edits allowed each stands
    near its own place in the longer text, and the edits of the pieces add up;
    where many wait, a third of them is often enough to rule a pair out.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short, long = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    most = long * (100 - percent) // 100
    ok = (long - short <= most) & (short > 0)
    flat = np.concatenate([*(x for p in pairs for x in p), np.zeros(64, np.uint8)])  # a lane reads 64 at any place
    from_a = np.cumsum(short + long) - short - long
    from_b = from_a + short
    count = -(-short // 64)
    edits = np.zeros(len(pairs), np.int64)
    turns = 1 if count.sum() < _LANES else 3
    for turn in range(turns):
        who = np.flatnonzero(ok)
        each = (count[who] + turns - 1 - turn) // turns
        pair = np.repeat(who, each)
        if not len(pair):
            continue
        piece = turns * (np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)) + turn
        first, last = short[pair] * piece // count[pair], short[pair] * (piece + 1) // count[pair]
        more = long[pair] - short[pair]
        left, right = np.maximum(first - (most[pair] - more) // 2, 0), np.minimum(last + (most[pair] + more) // 2, long[pair])
        np.add.at(edits, pair, _least_edits(flat, from_a[pair] + first, last - first, from_b[pair] + left, right - left, piece == 0, piece == count[pair] - 1))
        ok &= edits <= most
    return ok | (short == 0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _near(group: Group, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``rest`` have SimHashes near that of i, and lengths that the edit rule allows."""
    hi, lo, size = group["hi"].view(np.uint64), group["lo"].view(np.uint64), group["size"]
    shorter, longer = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
    near = 100 * shorter.astype(np.int64) >= percent * longer.astype(np.int64)
    near[near] = np.bitwise_count(hi[rest[near]] ^ hi[i]).astype(int) + np.bitwise_count(lo[rest[near]] ^ lo[i]) <= RADIUS
    return near


Asked = Generator[tuple[int, np.ndarray], np.ndarray, list[tuple[int, int]]]


def _outwards(size: int) -> Asked:
    """A search outwards from each row that nobody has reached: it asks which of some rows are near one, and returns the first row of each connected set with each of the others."""
    rest, out = np.arange(size), []
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        front = [first]
        while front and len(rest):
            found = yield front.pop(), rest
            reached = rest[found].tolist()
            out += [(first, j) for j in reached]
            front += reached
            rest = rest[~found]
    return out


def _answered(search: Asked, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """What a search returns if ``near`` answers it."""
    found = None
    while True:
        try:
            i, rest = search.send(found)
        except StopIteration as end:
            return end.value
        found = near(i, rest)


def _apart(pair: np.ndarray) -> int:
    """Bits in which two 64-bit numbers differ."""
    return ((int(pair[0]) ^ int(pair[1])) & 0xFFFFFFFFFFFFFFFF).bit_count()


def _links(percent: int):
    def links(group: Group) -> Iterator[tuple[int, int]]:
        hi, lo, size = group["hi"], group["lo"], group["size"]
        if len(hi) == 2:  # most groups are pairs
            short, long = sorted((int(size[0]), int(size[1])))
            if 100 * short >= percent * long and _apart(hi) + _apart(lo) <= RADIUS:
                yield 0, 1
            return
        yield from _answered(_outwards(len(hi)), lambda i, rest: _near(group, i, rest, percent))

    return links


#: Characters of the groups that are searched side by side; bits within which an alignment is tried first.
_SIDE, _CLOSE = 2_000_000, 24


class _Search:
    """A search of one group, with the pairs whose edits it waits for."""

    def __init__(self, group: Group, percent: int):
        lines = group["line"].tolist()
        self.group, self.percent = group, percent
        self.text = [x.decode("utf-8", "surrogatepass") for x in lines]
        self.kinds = list(map(_kinds, self.text))
        self.size = sum(map(len, lines))
        if len(lines) > 2:
            self.sims = simhashes(slots(lines))
            self.seen = {"hi": self.sims[:, 0], "lo": self.sims[:, 1], "size": np.array(list(map(len, self.text)))}
        self.steps = _outwards(len(lines))
        self.links: list[tuple[int, int]] | None = None
        self.go(None)

    def go(self, found: np.ndarray | None) -> None:
        """On to the next pairs; links is set at the end."""
        while True:
            try:
                self.i, rest = self.steps.send(found)
            except StopIteration as end:
                self.links = end.value
                return
            i, two = self.i, len(self.text) == 2
            found = np.ones(1, bool) if two else _near(self.seen, i, rest, self.percent)
            self.open = []
            for k in np.flatnonzero(found).tolist():
                j = int(rest[k])
                close = two or _apart(self.sims[[i, j], 0]) + _apart(self.sims[[i, j], 1]) <= _CLOSE
                if not (close and _shown(self.text[i], self.text[j], self.percent)):
                    self.open.append((k, j))
            self.found = found
            if self.open:
                return

    def told(self, maybe: np.ndarray) -> None:
        for (k, j), m in zip(self.open, maybe.tolist(), strict=True):
            self.found[k] = m and similar(self.text[self.i], self.text[j], self.percent)
        self.go(self.found)


def _edits(percent: int) -> Links:
    """Links by the edit rule; many groups are searched side by side, so that their pairs are ruled out many at a time."""

    def links(groups: Iterator[Group]) -> Iterator[tuple[Group, int, int]]:
        searches: list[_Search] = []
        more = True
        while more or searches:
            size = sum(s.size for s in searches)
            while more and size < _SIDE:
                group = next(groups, None)
                more = group is not None
                if more:
                    searches.append(_Search(group, percent))
                    size += searches[-1].size
            waiting = [s for s in searches if s.links is None]
            if waiting:
                maybe = _maybe([(s.kinds[s.i], s.kinds[j]) for s in waiting for _, j in s.open], percent)
                ends = np.cumsum([len(s.open) for s in waiting])
                for s, part in zip(waiting, np.split(maybe, ends[:-1]), strict=True):
                    s.told(part)
            for s in searches:
                for i, j in s.links or ():
                    yield s.group, i, j
            searches = [s for s in searches if s.links is None]

    return links


#: Lines of a neighbourhood that are verified together.
NEIGHBOURS = 2000


def _parted(likely: DataFrame, members: DataFrame) -> DataFrame:
    """(id_hi, key): the neighbourhoods ``likely``; of larger ones than NEIGHBOURS the bands (key, id) of their members.

    All pairs that share a band are still met, and the work grows with the
    bands and not with the square of a neighbourhood.
    """
    large = likely.groupBy("key").count().filter(F.col("count") > NEIGHBOURS).select("key")
    if not large.limit(1).count():
        return likely
    inside = likely.join(F.broadcast(large), "key").select("id_hi")
    bands = members.select(F.col("id").alias("id_hi"), "key").join(inside, "id_hi", "left_semi")
    return table(likely.join(F.broadcast(large), "key", "left_anti").unionByName(bands), "parted_lines")


def _id(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


_MANY = 20_000
_CLASS = "id_hi long, id_lo long, n long, hi long, lo long, size long, " + ", ".join(f"k{b} long" for b in range(BANDS))


def _classes(docs: DataFrame) -> DataFrame:
    """A row for each different line that holds letters or digits, with its SimHash, length and keys."""

    def frame(counts: Counter[bytes]) -> pa.RecordBatch:
        normal = list(counts)
        parts = slots(normal)
        sim, keys = simhashes(parts).view(np.int64), band_keys(parts)
        ids = np.frombuffer(b"".join(map(_id, normal)), np.int64).reshape(-1, 2)
        size = np.array([len(n) if n.isascii() else len(n.decode("utf-8", "surrogatepass")) for n in normal], np.int64)
        columns = (*ids.T, np.array(list(counts.values()), np.int64), *sim.T, size, *keys.T)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [x.split()[0] for x in _CLASS.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in it:
            for text in batch.column(0).to_pylist():
                counts.update(filter(None, normalised(text)))
                if len(counts) > _MANY:
                    yield frame(counts)
                    counts = Counter()
        if counts:
            yield frame(counts)

    lines = docs.select("text").mapInArrow(tidy(run), _CLASS)
    rest = [x.split()[0] for x in _CLASS.split(", ")[3:]]
    return lines.groupBy("id_hi", "id_lo").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in rest])  # equal within a class


def _members(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, id, hi, lo, size): the classes by those of their keys that others have too."""
    spark = classes.sparkSession
    sieve = KeyFilter(shared, "key")
    names = ["key", "id", "hi", "lo", "size"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for b in range(BANDS):
                key = batch.column(4 + b).to_numpy(zero_copy_only=False)
                there = np.flatnonzero(sieve.may_hold(key))
                yield pa.RecordBatch.from_arrays([pa.array(c[there]) for c in (key, *cols)], names)

    bounded_batches(spark)
    return classes.select("id_hi", "hi", "lo", "size", *(f"k{b}" for b in range(BANDS))).mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


_PLACE = "id binary, id_hi long, doc_id long, row long, at int, line binary"


def _places(docs: DataFrame, wanted: KeyFilter, texts: KeyFilter) -> DataFrame:
    """(id, id_hi, doc_id, row, at, line) of every line that may be wanted; line once a task, and only where its text may be."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in it:
            lines = [normalised(text) for text in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in lines], np.int64)
            normal = [n for x in lines for n in x]
            index = np.repeat(np.arange(len(lines)), sizes)
            at = np.arange(len(normal)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full = np.flatnonzero(np.fromiter(map(len, normal), np.int64, len(normal)))
            index, at, normal = index[full], at[full], list(filter(None, normal))
            ids = list(map(_id, normal))
            hi = np.frombuffer(b"".join(ids), np.int64)[::2]
            there = np.flatnonzero(wanted.may_hold(hi))
            said = texts.may_hold(hi[there])
            spoken: list[bytes | None] = []
            for k, say in zip(there.tolist(), said.tolist(), strict=True):
                say = say and ids[k] not in told
                if say:
                    told.add(ids[k])
                spoken.append(normal[k] if say else None)
            if len(told) > 10 * _MANY:
                told.clear()
            take = pa.array(index[there])
            cols = [pa.array([ids[k] for k in there.tolist()], pa.binary()), pa.array(hi[there]), batch.column(0).take(take), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at[there].astype(np.int32)), pa.array(spoken, pa.binary())], [x.split()[0] for x in _PLACE.split(", ")])

    return docs.select("doc_id", "row", "text").mapInArrow(tidy(run), _PLACE)


def _row() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def repeated_lines(documents: DataFrame, percent: int = 90) -> DataFrame:
    """(doc_id, row, ats): the line numbers that go from each document (doc_id, text); row is xxhash64 of the text.

    Two lines link if 100 * (longer - edits) >= percent * longer, over
    normalised lines; such pairs are found if they share one of BANDS bands
    and their SimHashes are within RADIUS bits.  The first occurrence by
    doc_id (nulls first), row and line number stays.  Rows with one doc_id and
    one text are one document: their lines stay or go together.  Lines
    without letters or digits, and so null and empty texts, are never removed.
    An empty table gives none.  Other columns are not read.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text"))
    classes = table(_classes(docs), "line_classes")
    # Keys are counted first: only the rows of those that meet are dealt.
    shared = key_sizes(classes.select(F.explode(F.array(*(f"k{b}" for b in range(BANDS)))).alias("key")))
    members = _members(classes, shared)
    likely = components(compare_in_blocks(members, one_by_one(_links(percent)), 4000, sizes=shared))
    likely = table(likely.select(F.col("node").alias("id_hi"), F.col("root").alias("key")), "likely_lines")
    wanted = classes.filter("n > 1").select("id_hi").union(likely.select("id_hi"))
    places = table(_places(docs, KeyFilter(wanted, "id_hi"), KeyFilter(likely, "id_hi")), "line_places")
    # Rows of one id_hi lie together after the join, so its copies go without a further shuffle.
    texts = places.filter("line is not null").join(_parted(likely, members), "id_hi").dropDuplicates(["id_hi", "key", "id"])
    texts = table(texts.select("key", "id", "line"), "line_texts")
    roots = components(compare_in_blocks(texts, _edits(percent), NEIGHBOURS, F.length("line"), TEXT_BLOCK)).withColumnRenamed("node", "id")
    # A line may stand in a third of all places: its rows are counted where they are, and meet a row for each line.
    each = places.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first"))
    each = table(each.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "line_groups")
    stays = each.groupBy("root").agg(F.count("*").alias("ids"), F.sum("n").alias("places"), F.min("first").alias("stays")).filter("places > 1")
    fate = join_hot(each.select("id", "n", "root"), stays.drop("places"), "root", "ids").select("id", "n", "stays")
    gone = join_hot(places.select("id", "doc_id", "row", "at"), fate, "id", "n").filter(~F.struct("doc_id", "row", "at").eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("ats"))


def _without(text: Column, ats: Column) -> Column:
    """A text without the lines of these numbers."""

    @F.arrow_udf("string")
    def left(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, numbers in zip(texts.to_pylist(), map(set, gone.to_pylist()), strict=True):
            out.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in numbers]))
        return pa.array(out, pa.string())

    return left(text, ats)


def dedup_lines(documents: DataFrame, percent: int = 90, removed: str = "n_removed_lines") -> DataFrame:
    """documents, all their columns, without repeated lines, and with the number of lines that went as column ``removed``.

    See repeated_lines for what goes; other lines stay as they are, in order.
    A document all of whose lines go has an empty text.  A null text stays
    null.  An n_chars column is brought up to date.  Further columns stay as
    they are; a table that has a column ``removed`` is refused.
    """
    names = documents.columns
    if removed.lower() in map(str.lower, names):
        raise ValueError(f"documents have a column {removed}; name another for the count")
    d, r, ats = free(names, "_d", "_r", "_ats")
    gone = settled(lambda: repeated_lines(documents, percent).withColumnsRenamed({"doc_id": d, "row": r, "ats": ats}), "gone_lines")
    # Only documents that may lose a line are shuffled.
    text = F.col("text").cast("string")
    may = KeyFilter(gone, r).column(F.coalesce(_row(), F.lit(0).cast("long")))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (_row() == F.col(r))
    met = documents.filter(may).join(gone, key, "left")
    left = F.when(F.col(ats).isNull(), F.col("text")).otherwise(_without(F.coalesce(text, F.lit("")), F.coalesce(ats, F.array().cast("array<int>"))))
    met = met.withColumn("text", left)
    if "n_chars" in names:
        met = met.withColumn("n_chars", F.when(F.col(ats).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    met = met.select(*_quoted(names), F.coalesce(F.size(ats), F.lit(0)).cast("long").alias(removed))
    return met.union(documents.filter(~may).select(*_quoted(names), F.lit(0).cast("long").alias(removed)))


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


