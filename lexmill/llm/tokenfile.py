"""Token ids in files of independently coded blocks: an adaptive context-mixing range coder.

Three predictions of the next id are mixed: how often each id came lately in the block (order
0), and the id that came last after the same one and the same two before (orders 1 and 2),
weighted by how often such expectations came true. The mixture, one interval for each id that
can come, drives a range coder. Every block begins with nothing learned, so blocks are coded
side by side, one lane of numpy arrays each, and read in any order by any task. Shares are
integers, and the one quotient of floating-point numbers has an exact floor, so any two
machines agree.

Nothing is searched for: counts that order 0 uses are refreshed a few times in a block and come
to a power of two, so a place among the sorted ids names the id, and shares are shifts. The
price is that order 0's share of an expected id is left unused.

A file is text lines, one block each, so that Spark writes, commits and splits it: a header
with the block's place, an index of the documents that begin in it, the coded ids, and
checksums of ids and of the rest. Line ends inside are escaped. Documents come in the order of
their ids, files in the order of their ranges.

Defined results: a null text is the empty text (the end id alone); null ids come first; rows
with the same id come by the checksum of their text, equal rows each for itself; an empty
table gives files without blocks; other columns are ignored. A block that doesn't agree with
its checksums raises an error.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.worker import kept, no_collection

#: Ids in a block, and blocks coded side by side.
BLOCK, LANES = 2048, 4096
#: Order-0 counts are refreshed whenever so many ids are known, all of which count, and every REFRESH ids beyond, when the last WINDOW count.
EARLY, REFRESH, WINDOW = (32, 64, 128, 256, 512, 1024), 512, 1024
#: Slots of the predictions of orders 1 and 2 in each lane; factors of their hashes, and shifts that leave a slot's bits.
SLOTS, _HASH = (1024, 4096), (np.uint32(0x2545F491), np.uint32(0x61C88647), np.uint32(22), np.uint32(20))
#: A prediction's shares come to 2^32; the coder's window is 64 bits, of which 32 leave it as a word.
_WHOLE, _WORD, _LOW, _LAST, _MASK = 1 << 32, np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 64) - 1)
#: Weight in 4096 of a new prediction, and the most with which a miss ends one.
_EXPECTED, _LEAST = 400, 700


class _Recent:
    """How often each id came among those that the last refresh took in: all before it, or the last ``WINDOW``."""

    @staticmethod
    def refreshes(n: int) -> list[tuple[int, int]]:
        """For ``n`` ids: where a refresh is, and how many ids before it count; that is a power of two."""
        early = [(t, t) for t in EARLY if t < n]
        return early + [(t, WINDOW) for t in range(WINDOW + REFRESH, n, REFRESH)]

    @staticmethod
    def known(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of lanes, a row each, as rows of places; how often the refresh before counted each; and how many smaller ones, or the id itself where it didn't."""
        lanes, n = ids.shape
        now, times, place = np.empty((n, lanes), np.uint16), np.zeros((n, lanes), np.uint16), np.empty((n, lanes), np.uint16)
        marks = [*_Recent.refreshes(n), (n, 0)]
        for a in range(0, lanes if n else 0, 64):  # few enough lanes for the processor's cache
            some = ids[a : a + 64]
            k = len(some)
            now[:, a : a + k] = place[:, a : a + k] = some.T
            order = some.astype(np.int64) << 32
            order |= np.arange(n)
            order.sort(axis=1)
            rank = np.zeros((k, n), np.int64)
            np.not_equal(order[:, 1:] >> 32, order[:, :-1] >> 32, out=rank[:, 1:], casting="unsafe")
            np.cumsum(rank, axis=1, out=rank)
            most = int(rank[:, -1].max()) + 1
            row = np.arange(k)[:, None]
            order &= 0xFFFFFFFF
            order += row * n
            rank += row * most
            #: Ids as numbers in each lane, in their order.
            dense = np.empty(k * n, np.int64)
            dense[order.ravel()] = rank.ravel()
            dense = dense.reshape(k, n)
            for (t, count), (until, _) in zip(marks, marks[1:], strict=False):
                seen = np.bincount(dense[:, t - count : t].ravel(), minlength=k * most)
                # The sum over all lanes: each has counted the same number before its first id, a power of two.
                smaller = np.cumsum(seen) - seen & count - 1
                asked = dense[:, t:until]
                found = seen.take(asked)
                times[t:until, a : a + k] = found.T
                place[t:until, a : a + k] = np.where(found > 0, smaller.take(asked), some[:, t:until]).T
        return now, times, place

    @staticmethod
    def table(ids: np.ndarray) -> np.ndarray:
        """For what a refresh counts, in rows of places: of each lane the ids in their order, below them how often, below that how many smaller ones."""
        n, lanes = ids.shape
        out = np.empty((lanes, n), np.int64)
        for a in range(0, lanes, 64):
            rows = np.sort(np.ascontiguousarray(ids[:, a : a + 64].T).astype(np.uint16), axis=1, kind="stable")
            new = np.ones(rows.shape, bool)
            np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
            first = np.flatnonzero(new)
            times = np.diff(first, append=rows.size)
            some = np.repeat(first & n - 1 | times << 16, times)
            some |= rows.ravel().astype(np.int64) << 32
            out[a : a + 64] = some.reshape(rows.shape)
        return out.ravel()


class _Mixture:
    """The mixed prediction of the next id in every lane, as shares of 2^32.

    Orders 1 and 2 expect an id each, with a weight learned from how often that came true; order
    2's comes off the whole, order 1's off the rest, and an id that both expect has both. What is
    left is order 0's: ids that the last refresh counted share it by their counts, and a part,
    learned too, goes to all ids evenly.
    """

    def __init__(self, lanes: int):
        #: Of order 1 and then order 2: an expected id, plus one, above its weight in 4096; 0 is an empty slot.
        self.slots = np.zeros(lanes * sum(SLOTS), np.int32)
        self.new = np.full(lanes, 2048, np.int64)
        lane = np.arange(lanes, dtype=np.int64)
        self.lane_slots = np.stack([lane * SLOTS[0], lanes * SLOTS[0] + lane * SLOTS[1]])
        self.last = np.zeros(lanes, np.uint32)

    def predict(self, last: np.ndarray, counted: int) -> None:
        """After the id ``last`` in each lane; the last refresh counted so many ids, or none."""
        k = len(last)
        lane_slots = self.lane_slots[:, :k]
        one = last.astype(np.uint32)
        one *= _HASH[0]
        two = self.last[:k] * _HASH[1]
        two += one
        self.last = one
        at = self.at = np.empty((2, k), np.int64)
        np.add(one >> _HASH[2], lane_slots[0], out=at[0])
        np.add(two >> _HASH[3], lane_slots[1], out=at[1])
        slot = self.slot = self.slots.take(at)
        self.ids = slot >> 12
        chance = self.chance = slot & 4095
        self.two = chance[1].astype(np.int64)
        self.two <<= 20
        rest = _WHOLE - self.two
        self.one = rest >> 12
        self.one *= chance[0]
        rest -= self.one
        ahead = self.ahead = self.two + self.one
        self.counted = counted
        if counted:
            even = rest >> 12
            even *= self.new[:k]
            even >>= 16
            even += 1
            rest -= even << 16
            self.begin_even = ahead + rest
            rest >>= counted.bit_length() - 1
            self.even, self.each = even, rest
        else:
            rest >>= 16
            self.even, self.begin_even = rest, ahead

    def choose(self, unseen: np.ndarray) -> None:
        """Where order 0's shares begin that the ids are among, and their unit: those of all ids, or of ids counted."""
        self.unseen = unseen
        if self.counted:
            self.base, self.unit = np.where(unseen, self.begin_even, self.ahead), np.where(unseen, self.even, self.each)
        else:
            self.base, self.unit = self.ahead, self.even

    def bounds(self, ids: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' shares begin, and their sizes; order 0's is of ``times`` units (0: one) behind ``place`` others."""
        begin = self.unit * place
        begin += self.base
        size = self.unit * np.maximum(times, 1)
        next_ = self.next = ids.astype(np.int32)
        next_ += 1
        self.same = self.ids == next_
        at = self.right = np.flatnonzero(self.same[0] | self.same[1])
        first, second, two = self.same[0][at], self.same[1][at], self.two[at]
        begin[at] = two * ~second
        size[at] = two * second + self.one[at] * first
        return begin, size

    def find(self, target: np.ndarray, table: np.ndarray, lane_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose shares hold ``target``, and order 0's place and times."""
        self.choose(target >= self.begin_even)
        rest = target - self.base
        ahead = np.flatnonzero(rest < 0)
        rest[ahead] = 0
        # Both are below 2^32 and the quotient is below 2^16, so its floor is exact.
        place = (rest / self.unit).astype(np.int64)
        if self.counted:
            found = table.take(np.minimum(place, self.counted - 1) + lane_table)
            ids, times = found >> 32, found >> 16 & 0xFFFF
            found &= 0xFFFF
            at = np.flatnonzero(self.unseen)
            ids[at] = found[at] = place[at]
            times[at] = 0
            place = found
        else:
            ids, times = place.copy(), np.zeros(len(place), np.int64)
        ids[ahead] = np.where(target[ahead] < self.two[ahead], self.ids[1][ahead], self.ids[0][ahead]) - 1
        return ids, place, times

    def learn(self) -> None:
        # A weight stays within 1 and 4047 of 4096, the even part within 15 and 3471: all shares have a size.
        new = self.new[: len(self.next)]
        if self.counted:
            kept = new[self.right]
            new -= new >> 4
            new += self.unseen * np.int64(216)
            new[self.right] = kept
        # What came true gains weight; what didn't loses half, and its place once little is left.
        fresh = self.next << 12
        fresh |= _EXPECTED
        after, chance = np.concatenate([fresh, fresh]), self.chance.ravel()
        right = self.same.ravel()
        at = np.flatnonzero(right | (chance > _LEAST))
        weight = chance[at]
        after[at] = self.slot.ravel()[at] + np.where(right[at], 4048 - weight >> 2, -(weight + 1 >> 1))
        self.slots[self.at.ravel()] = after


def _active(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each place, and how many of the lanes, which are sorted by falling length, have an id there."""
    ends = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    yield from enumerate(ends.tolist())


def _encode_lanes(ids: np.ndarray, n: np.ndarray) -> list[bytes]:
    lanes, longest = ids.shape
    mixture = _Mixture(lanes)
    ids, times, place = _Recent.known(ids)
    refresh, counted = dict(_Recent.refreshes(longest)), 0
    lows, widths = np.zeros(lanes, np.uint64), np.full(lanes, _MASK)
    most = longest + 3  # an id takes one word at most
    out, at = np.zeros(lanes * most, np.uint32), np.arange(lanes, dtype=np.int64) * most
    last = np.zeros(lanes, np.uint16)
    for t, k in _active(n):
        counted = refresh.get(t, counted)
        now, often = ids[t, :k], times[t, :k]
        mixture.predict(last[:k], counted)
        mixture.choose(often == 0)
        begin, share = mixture.bounds(now, place[t, :k], often)
        low, width = lows[:k], widths[:k]
        unit = width >> _WORD
        add = unit * begin.view(np.uint64)
        low += add
        for lane in np.flatnonzero(low < add):  # a carry into what is written
            i = at[lane] - 1
            while out[i] == _LAST:
                out[i], i = 0, i - 1
            out[i] += 1
        np.multiply(unit, share.view(np.uint64), out=width)
        small = np.flatnonzero(width < _LOW)
        done, to = low[small], at[small]
        out[to] = done >> _WORD
        at[small] = to + 1
        low[small] = done << _WORD
        width[small] <<= _WORD
        mixture.learn()
        last = now
    out[at] = lows >> _WORD
    out[at + 1] = lows & _LAST
    ends = at + 2 - np.arange(lanes) * most
    return [row[:end].astype("<u4").tobytes() for row, end in zip(out.reshape(lanes, most), ends.tolist(), strict=True)]


def _decode_lanes(coded: list[bytes], n: np.ndarray) -> np.ndarray:
    lanes, longest = len(n), int(n[0])
    mixture = _Mixture(lanes)
    most = max(map(len, coded)) // 4 + 3
    words = np.zeros((lanes, most), np.uint32)
    for row, c in zip(words, coded, strict=True):
        row[: len(c) // 4] = np.frombuffer(c, "<u4")
    codes = words[:, 0].astype(np.uint64) << _WORD | words[:, 1]
    words = words.ravel()
    lane = np.arange(lanes, dtype=np.int64)
    at = lane * most + 2
    widths = np.full(lanes, _MASK)
    refresh = dict(_Recent.refreshes(longest))
    counted, table, lane_table = 0, np.zeros(0, np.int64), lane
    ids = np.zeros((longest, lanes), np.uint16)
    last = np.zeros(lanes, np.uint16)
    for t, k in _active(n):
        if t in refresh:
            counted = refresh[t]
            table, lane_table = _Recent.table(ids[t - counted : t, :k]), lane * counted
        mixture.predict(last[:k], counted)
        code, width = codes[:k], widths[:k]
        unit = width >> _WORD
        now, place, times = mixture.find((code // unit).view(np.int64), table, lane_table[:k])
        begin, share = mixture.bounds(now, place, times)
        code -= unit * begin.view(np.uint64)
        np.multiply(unit, share.view(np.uint64), out=width)
        small = np.flatnonzero(width < _LOW)
        to = at[small]
        code[small] = code[small] << _WORD | words[to]
        at[small] = to + 1
        width[small] <<= _WORD
        mixture.learn()
        ids[t, :k] = now
        last = ids[t]
    out = np.empty((lanes, longest), np.uint16)
    for a in range(0, lanes, 64):
        out[a : a + 64] = ids[:, a : a + 64].T
    return out


def _groups(items: list, lanes: int) -> Iterator[list]:
    """As few groups as ``lanes`` allow, of nearly equal size."""
    count = -(-len(items) // lanes)
    for i in range(count):
        yield items[i * len(items) // count : (i + 1) * len(items) // count]


def encode_blocks(blocks: list[np.ndarray], lanes: int = LANES) -> list[bytes]:
    """Each block of ids below 65,536 coded for itself."""
    out: list[bytes] = [b""] * len(blocks)
    for part in _groups(sorted(range(len(blocks)), key=lambda i: -len(blocks[i])), lanes):
        n = np.array([len(blocks[i]) for i in part], np.int64)
        ids = np.zeros((len(part), int(n[0])), np.uint16)
        for row, i in zip(ids, part, strict=True):
            row[: len(blocks[i])] = blocks[i]
        for i, coded in zip(part, _encode_lanes(ids, n), strict=True):
            out[i] = coded
    return out


def decode_blocks(coded: list[tuple[int, bytes]], lanes: int = LANES) -> list[np.ndarray]:
    """The ids of blocks given as (how many, what ``encode_blocks`` made)."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(coded)
    for part in _groups(sorted(range(len(coded)), key=lambda i: -coded[i][0]), lanes):
        n = np.array([coded[i][0] for i in part], np.int64)
        for i, row in zip(part, _decode_lanes([coded[i][1] for i in part], n), strict=True):
            out[i] = row[: coded[i][0]]
    return out


# ---- lines of a file ------------------------------------------------------------------------------------------------

_MAGIC = b"LXT2"
#: Magic, part, number of the block, its ids, ids that belong to a document begun before, ordinal of the first document that begins here, lengths of index and code, CRC-32 of the ids.
_HEADER = "<4sIIIIQIII"
_HEADER_SIZE = struct.calcsize(_HEADER)


def _line(part: int, number: int, ids: np.ndarray, carried: int, first: int, begun: list, coded: bytes) -> bytes:
    index = json.dumps(begun, separators=(",", ":")).encode()
    if len(index) > 200:  # a short one isn't worth it; JSON begins with a bracket, what is compressed doesn't
        index = zlib.compress(index)
    whole = struct.pack(_HEADER, _MAGIC, part, number, len(ids), carried, first, len(index), len(coded), zlib.crc32(ids.astype("<u4").tobytes())) + index + coded
    whole += struct.pack("<I", zlib.crc32(whole))
    return whole.replace(b"\x1b", b"\x1b\x02").replace(b"\n", b"\x1b\x01")


def _parsed(line: bytes) -> tuple[int, int, int, int, int, list, bytes, int]:
    whole = line.replace(b"\x1b\x01", b"\n").replace(b"\x1b\x02", b"\x1b")
    if len(whole) < _HEADER_SIZE + 4 or whole[:4] != _MAGIC or zlib.crc32(whole[:-4]) != struct.unpack("<I", whole[-4:])[0]:
        raise ValueError("a block of a token file is damaged")
    _, part, number, n, carried, first, index, size, crc = struct.unpack_from(_HEADER, whole)
    at = _HEADER_SIZE + index
    begun = whole[_HEADER_SIZE:at]
    return part, number, n, carried, first, json.loads(begun if begun[:1] == b"[" else zlib.decompress(begun)), whole[at : at + size], crc


# ---- tokens of a text -----------------------------------------------------------------------------------------------

#: The characters that stand for bytes in a byte-level vocabulary where those of the same number don't: from U+0100 on.
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE))}
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
#: Classes of bytes in words of letters to U+00FF, digits and ASCII marks. Other bytes, apostrophes (contractions) and "<" (added tokens) make a word one for the library as a whole.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_CLASS[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0xC0)) + [0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x27, 0x3C, 0x97, 0xB7]] = _OTHER  # the last two end the signs of multiplication and division
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(range(0x41, 0x5B)) + list(range(0x80, 0x9F))] += 0x20


#: Bytes of texts that are cut into pieces at a time, and that are encoded at a time.
_NEAR, _GROUP = 1 << 17, 1 << 23


def _cuts(data: np.ndarray, start: int, end: int) -> Iterator[int]:
    """Places of white space in a long text, about ``_NEAR`` bytes apart."""
    at = start + _NEAR
    while at < end:
        spaces = np.flatnonzero(_CLASS.take(data[at : min(at + _NEAR, end)]) == _SPACE)
        if spaces.size:
            at += int(spaces[0])
            yield at
        at += _NEAR


def _pieces(data: np.ndarray, ends: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """What a vocabulary of words makes pieces of, in lower case, in texts that end there: runs of letters, digits, runs of marks, and whole words of ``_OTHER`` as they are; and how many lie before each end."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw.translate(_CLASS.tobytes())), np.uint8)
    lower = np.frombuffer(bytearray(raw.translate(_LOWER.tobytes())), np.uint8)
    # What goes on a character without a lead of ours, or the other way round; characters don't go on in the next text.
    lead, stray = data == 0xC3, data.view(np.int8) < -64
    inside = ends[(ends > 0) & (ends < len(data))]
    split = inside[lead[inside - 1] | stray[inside]]
    stray[1:] ^= lead[:-1]
    stray[-1] |= lead[-1]
    stray[split] = True
    stray = np.flatnonzero(stray)
    kind[stray[kind[stray] != _SPACE]] = _OTHER
    begins = np.ones(len(data), bool)
    if (other := np.flatnonzero(kind == _OTHER)).size:
        begins[1:] = (kind[1:] == _SPACE) != (kind[:-1] == _SPACE)
        begins[inside] = True
        runs = np.flatnonzero(begins)
        whole = np.zeros(len(runs), bool)
        whole[np.searchsorted(runs, other, side="right") - 1] = True
        for a, b in zip(runs[whole].tolist(), np.append(runs, len(data))[1:][whole].tolist(), strict=True):
            kind[a:b], lower[a:b] = _OTHER, data[a:b]
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _DIGIT
    begins[inside] = True
    full = kind != _SPACE
    begins &= full
    lower = lower[full]
    offsets = np.append(np.flatnonzero(begins[full]), len(lower)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lower)])
    return pieces, np.searchsorted(np.flatnonzero(begins), ends)


class Words(dict):
    """Ids, as 16-bit numbers, of the pieces met so far; white space never joins what a vocabulary of words makes of them.

    Emptied when ``most`` pieces are known.
    """

    def __init__(self, tokenizer, most: int = 1_500_000):
        super().__init__()
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if piece.isalpha():  # ASCII letters, in lower case: each byte its own character
            ids = array("H", [t.id for t in self.model.tokenize(piece.decode())]).tobytes()
        else:
            spelled = piece.decode(errors="replace")
            if spelled.isalpha() and max(spelled) < "\u0100":  # one piece, composed already
                known = self.model.tokenize(spelled.lower().encode().decode("latin-1").translate(_BYTES))
                ids = array("H", [t.id for t in known]).tobytes()
            else:
                ids = array("H", self.tokenizer.encode(spelled, add_special_tokens=False).ids).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def texts(self, texts: pa.BinaryArray, end: bytes) -> tuple[bytes, np.ndarray]:
        """The ids of all texts (null: none), ``end`` behind each, and how many of them lie before each text and in all."""
        texts = texts.fill_null(b"")
        if texts.buffers()[2] is None or not len(texts):
            return end * len(texts), np.arange(len(texts) + 1) * (len(end) // 2)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        # Little enough at a time for the processor's cache; long texts are cut at white space.
        cuts = np.array([c for i in np.flatnonzero(np.diff(bounds) > 2 * _NEAR) for c in _cuts(data, *bounds[i : i + 2].tolist())], np.int64)
        ends = np.sort(np.concatenate([bounds, cuts]))
        parts, before, n, a = [], [np.zeros(1, np.int64)], 0, 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _NEAR, side="right")) - 1)
            part, own = _pieces(data[ends[a] : ends[b]], ends[a + 1 : b + 1] - ends[a])
            parts.append(part)
            before.append(own + n)
            n, a = n + len(part), b
        before = np.concatenate(before)
        if len(cuts):
            before = np.delete(before, np.searchsorted(ends, cuts))
        before = before[1:]
        coded = pa.concat_arrays(parts).dictionary_encode()
        del parts, part
        known = [self[p] for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known.append(end)
        codes = np.insert(coded.indices.to_numpy(), before, len(known) - 1)
        ids = pa.array(known, pa.binary()).take(pa.array(codes))
        at = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
        behind = at[before + np.arange(1, len(texts) + 1)] // 2
        return ids.buffers()[2].slice(0, int(at[-1])).to_pybytes(), np.concatenate([[0], behind])

    def text(self, text: bytes) -> bytes:
        return self.texts(pa.array([text], pa.binary()), b"")[0]


def _words_of(vocabulary) -> Words:
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_str(vocabulary.value))


# ---- files ----------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = BLOCK) -> None:
    """The ids of all texts, each with ``end_id`` behind it, as token files under ``path``."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary: it doesn't grow with the data
    key = shared._jbroadcast.id()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = kept(("words", key), lambda: _words_of(shared))
        number, ordinal, left = 0, 0, 0  # the next block, the next document, and how much of the last one is still to come
        held: list[bytes] = []
        begun: list[tuple[int, list]] = []  # documents by where they begin in what is held
        size = 0

        def lines(final: bool) -> list[bytes]:
            nonlocal number, ordinal, left, held, begun, size
            ids = np.frombuffer(b"".join(held), "<u2")
            cut = len(ids) if final else len(ids) // block * block
            blocks = [ids[a : min(a + block, cut)] for a in range(0, cut, block)]
            out, at = [], 0
            for i, (b, coded) in enumerate(zip(blocks, encode_blocks(blocks), strict=True)):
                own = []
                while at < len(begun) and begun[at][0] < i * block + len(b):
                    own.append(begun[at][1])
                    at += 1
                carried = min(left, len(b))
                out.append(_line(part, number, b, carried, ordinal, own, coded))
                left += sum(x[1] for x in own) - len(b)
                ordinal, number = ordinal + len(own), number + 1
            held, size = [ids[cut:].tobytes()], len(ids) - cut
            begun = [(p - cut, x) for p, x in begun[at:]]
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            group = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64) // _GROUP
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                with no_collection():
                    ids, at = words.texts(texts.slice(a, b - a), end)
                held.append(ids)
                named = zip(batch.column(0).slice(a, b - a).to_pylist(), np.diff(at).tolist(), strict=True)
                begun += zip((at[:-1] + size).tolist(), map(list, named), strict=True)
                size += int(at[-1])
                if size >= block * LANES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines(False), pa.binary())], ["value"])
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(lines(True), pa.binary())], ["value"])

    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), crc.alias("crc")).repartitionByRange("id", "crc").sortWithinPartitions("id", "crc")
    coded = ordered.select("id", "text").mapInArrow(run, "value binary")
    coded.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements modulo CRC-32's, in its bit order."""
    out = 0
    for _ in range(32):
        if b & 0x80000000:
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        b = b << 1 & 0xFFFFFFFF
    return out


#: x to the power 8 * 2^k.
_POWERS = [0x00800000]
for _ in range(63):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_joined(first: int, then: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second's length."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            first = _times(first, _POWERS[k])
        n_bytes, k = n_bytes >> 1, k + 1
    return first ^ then


def read(spark: SparkSession, path: str, id_type: str = "long", block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document of the files under ``path``, from their decoded blocks; with ``ids`` where asked for.

    ``start`` counts the ids of all documents before it, over all files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_parsed(x.as_py()) for x in batch.column(0)]
            for some in _groups(lines, LANES):
                out = []
                for (part, number, n, carried, first, begun, _, crc), ids in zip(some, decode_blocks([(x[2], x[6]) for x in some]), strict=True):
                    flat = ids.astype("<u4").tobytes()
                    if zlib.crc32(flat) != crc:
                        raise ValueError(f"block {number} of part {part} of a token file is damaged")
                    at = 0
                    rest = [(first - 1, None, None, carried)] if carried else []
                    for ordinal, doc, total, size in [*rest, *((first + i, x[0], x[1], x[1]) for i, x in enumerate(begun))]:
                        own = flat[4 * at : 4 * (at + size)]
                        row = {"part": part, "ordinal": ordinal, "block": number, "n": len(own) // 4, "crc": zlib.crc32(own), "id": doc, "at": None if total is None else number * block + at, "total": total}
                        out.append(row | ({"ids": np.frombuffer(own, "<i4").tolist()} if with_ids else {}))
                        at += size
                yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(id_type)
    fields = [("part", pa.int64()), ("ordinal", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("id", to_arrow_type(kind)), ("at", pa.int64()), ("total", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    pieces = lines.mapInArrow(run, f"part long, ordinal long, block long, n long, crc long, id {id_type}, at long, total long" + (", ids array<int>" if with_ids else ""))

    @F.pandas_udf("long")
    def joined(parts):
        def one(xs) -> int | None:
            if xs is None:
                return None
            crc = xs[0]["crc"]
            for x in xs[1:]:
                crc = crc_joined(crc, x["crc"], 4 * x["n"])
            return crc

        return parts.map(one)

    # A document lies in as many blocks as its ids fill; only their checksums meet.
    listed = F.array_sort(F.collect_list(F.struct("block", "n", "crc", *(["ids"] if with_ids else []))))
    found = pieces.groupBy("part", "ordinal").agg(F.max("id").alias("id"), F.max("at").alias("at"), F.max("total").alias("n_tokens"), listed.alias("p"))
    # Python joins those of documents in several blocks only.
    several = F.when(F.size("p") > 1, F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["crc"].alias("crc"))))
    found = found.select("part", "id", "at", "n_tokens", F.coalesce(joined(several), F.col("p")[0]["crc"]).alias("ids_crc32"), *([F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")] if with_ids else []))
    return found.join(F.broadcast(starts(lines)), "part").select("id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def starts(lines: DataFrame) -> DataFrame:
    """``(part, first)``: the ids in all parts before. One row for each file, from the headers of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [struct.unpack_from(_HEADER, x.as_py()[:200].replace(b"\x1b\x01", b"\n").replace(b"\x1b\x02", b"\x1b")) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in heads], pa.int64()), pa.array([h[3] for h in heads], pa.int64())], ["part", "n"])

    from pyspark.sql.window import Window

    totals = lines.mapInArrow(run, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
