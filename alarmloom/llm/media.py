"""Media columns: baseline JPEG files, parsed and decoded in numpy, with DC-only luminance thumbnails.

The decoder reads any baseline file of 8-bit samples: one interleaved scan or
several, any sampling factors, with or without restart intervals. Huffman codes
are read for all restart intervals of a scan (and of many files) side by side:
each step takes one symbol of every interval, so the work is a few array
operations a symbol.

The encoder keeps bytes, not pictures: a payload's bytes, less 128, are the
quantised coefficients of 8 x 8 blocks of a grey picture, 64 bytes a block in zigzag
order. Entropy coding is lossless, so the bytes read back are the bytes stored.
The table gives the DC term a step of 8, so each pixel of the thumbnail is the
first byte of its block. Each block is a restart interval of its own, so a damaged
or huge file can be read from any block on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import Rows, pieces
from .common import numbered

UNIT = 576
SLICE_BLOCKS = 4_096
LANES = 8_192


def zigzag() -> np.ndarray:
    """Natural position (row * 8 + column) of each coefficient in file order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


# ---------------------------------------------------------------- Huffman tables


def canonical(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol of a table that has ``counts[i]`` codes of i + 1 bits."""
    code, out = 0, []
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def lookup_table(counts: list[int], symbols: bytes) -> np.ndarray:
    """For each 16 bits, length * 256 + symbol of the code they begin with; 0 if none."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for (code, length), symbol in zip(canonical(counts), symbols):
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = length << 8 | symbol
    return table


def payload_tables() -> tuple[tuple[list[int], bytes], tuple[list[int], bytes]]:
    """Huffman tables for bytes as coefficients: a code of 4 bits for each size that a byte's value may have
    (and, for AC, the end of the block), 9 bits for those sizes behind a run of zeros."""
    dc = [0] * 16, bytes(range(9))
    dc[0][3] = 9
    short = bytes([0, *range(1, 9)])
    long = bytes([0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 9))])
    ac = [0] * 16, short + long
    ac[0][3], ac[0][8] = len(short), len(long)
    return dc, ac


def size_of(values: np.ndarray) -> np.ndarray:
    """Number of bits of the magnitude of each value."""
    return np.frexp(np.abs(values).astype(np.float32))[1].astype(np.int64)


# ---------------------------------------------------------------- encoding


class PayloadCodes:
    """Codes of the payload's tables, by symbol, and the whole words (code, then value bits) of each byte that no zero stands before."""

    def __init__(self):
        dc, ac = payload_tables()
        self.dc, self.ac = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
        for into, (counts, symbols) in ((self.dc, dc), (self.ac, ac)):
            for (code, length), symbol in zip(canonical(counts), symbols):
                into[:, symbol] = code, length
        value = np.arange(256) - 128
        self.size = size_of(value)
        self.bits = np.where(value < 0, value + (1 << self.size) - 1, value)
        self.dc_word, self.dc_width = self.dc[0][self.size] << self.size | self.bits, self.dc[1][self.size] + self.size
        self.ac_word, self.ac_width = self.ac[0][self.size] << self.size | self.bits, self.ac[1][self.size] + self.size
        self.ac_word[128] = self.ac_width[128] = 0  # zeros are told by what comes after them


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def layout(blocks: int) -> tuple[int, int]:
    """Blocks across and down: three times as many across as the root of the payload's units, so about as wide as high."""
    units = blocks * 64 // UNIT
    across = 3 * max(1, isqrt(max(0, units - 1)) + 1)
    return across, -(-blocks // across)


def header(blocks: int) -> bytes:
    across, down = layout(blocks)
    dc, ac = payload_tables()
    return b"".join(
        (
            b"\xff\xd8",
            segment(0xFE, f"payload {blocks * 64}".encode()),
            segment(0xDB, bytes([0, 8] + [1] * 63)),
            segment(0xC0, bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            *(segment(0xC4, bytes([kind, *counts]) + symbols) for kind, (counts, symbols) in ((0x00, dc), (0x10, ac))),
            segment(0xDD, (1).to_bytes(2, "big")),
            segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


def code_blocks(values: np.ndarray, numbers: np.ndarray, codes: PayloadCodes) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded blocks of bytes, and where each ends.

    Each is padded to whole bytes and, but for number 0 of a file, stands behind
    a restart marker. ``numbers``: each block's number in its file.
    """
    n = len(values)
    word, width = codes.ac_word[values], codes.ac_width[values]
    word[:, 0], width[:, 0] = codes.dc_word[values[:, 0]], codes.dc_width[values[:, 0]]
    zero = values == 128
    zero[:, 0] = False
    end = np.where(zero[:, 63], codes.ac[1][0], 0)
    if zero.any():
        behind_zeros(values, zero, word, width, codes)
    total = width.sum(axis=1) + end
    held = -(-total // 8)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(held * 8, out=start[1:])
    tail = start[:-1] + total - end
    word, width = joined(word, width)
    begin = start[:-1, None] + np.cumsum(width, axis=1) - width
    some = width > 0
    buffer = put_bits(begin[some], word[some], width[some], int(start[-1]))
    some = end > 0
    put_bits(tail[some], np.full(int(some.sum()), codes.ac[0][0]), end[some], 0, buffer)
    pad = held * 8 - total
    some = pad > 0
    put_bits((tail + end)[some], ((1 << pad) - 1)[some], pad[some], 0, buffer)
    data = buffer[: int(start[-1]) // 8]
    # a zero byte behind each 0xFF, a restart marker before each block
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0xFF, out=before[1:])
    marked = numbers > 0
    markers = np.cumsum(2 * marked)
    at = np.arange(len(data)) + before[:-1] + np.repeat(markers, held)
    ends = start[1:] // 8 + before[start[1:] // 8] + markers
    out = np.zeros(int(ends[-1]), np.uint8)
    out[at] = data
    ahead = (np.r_[0, ends[:-1]])[marked]
    out[ahead], out[ahead + 1] = 0xFF, 0xD0 + ((numbers[marked] - 1) & 7)
    return out, ends


def behind_zeros(values: np.ndarray, zero: np.ndarray, word: np.ndarray, width: np.ndarray, codes: PayloadCodes) -> None:
    """Puts in the words of values that zeros stand before: up to three codes of sixteen zeros, then the run and the value."""
    position = np.arange(64)
    last = np.maximum.accumulate(np.where(zero, 0, position), axis=1)
    rows, columns = np.nonzero(zero[:, :-1] & ~zero[:, 1:])
    columns = columns + 1
    run = columns - last[rows, columns - 1] - 1
    byte = values[rows, columns]
    size = codes.size[byte]
    symbol = (run & 15) << 4 | size
    new = codes.ac[0][symbol] << size | codes.bits[byte]
    wide = codes.ac[1][symbol] + size
    sixteens = run >> 4
    for k in range(3):
        more = sixteens > k
        new = np.where(more, codes.ac[0][0xF0] << wide | new, new)
        wide = np.where(more, wide + codes.ac[1][0xF0], wide)
    word[rows, columns], width[rows, columns] = new, wide


def joined(word: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours put together as long as they are 56 bits at most."""
    while word.shape[1] > 1:
        both = width[:, ::2] + width[:, 1::2]
        if int(both.max()) > 56:
            break
        word, width = word[:, ::2] << width[:, 1::2] | word[:, 1::2], both
    return word, width


def put_bits(begin: np.ndarray, word: np.ndarray, width: np.ndarray, total: int, buffer: np.ndarray | None = None) -> np.ndarray:
    """Writes each of ``word`` at bit ``begin`` of a buffer of ``total`` bits; words may be up to 56 bits wide and do not overlap."""
    if buffer is None:
        buffer = np.zeros(-(-total // 64) * 8 + 16, np.uint8)
    if len(begin):
        cell, within = begin >> 6, begin & 63
        left = 64 - within - width
        w = word.astype(np.uint64)
        high = np.where(left >= 0, w << np.maximum(left, 0).astype(np.uint64), w >> np.maximum(-left, 0).astype(np.uint64))
        low = np.where(left < 0, w << (64 + np.minimum(left, -1)).astype(np.uint64), np.uint64(0))
        cells = buffer.view(">u8")
        own = np.zeros(len(cells), np.uint64)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        own[cell[starts]] = np.bitwise_or.reduceat(high, starts)
        over = left < 0  # at most one word of a cell goes over into the next
        own[cell[over] + 1] |= low[over]
        cells |= own.astype(">u8")
    return buffer


_codes: list[PayloadCodes] = []


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, whose length is a positive multiple of 64."""
    if not _codes:
        _codes.append(PayloadCodes())
    counts = [len(p) // 64 for p in payloads]
    spares = [across * down - n for n, (across, down) in zip(counts, map(layout, counts))]
    values = np.frombuffer(b"".join(x for p, spare in zip(payloads, spares) for x in (p, b"\x80" * (64 * spare))), np.uint8).reshape(-1, 64)
    numbers = np.concatenate([np.arange(n + spare) for n, spare in zip(counts, spares)])
    coded, ends, base = [], [np.zeros(1, np.int64)], 0
    for first in range(0, len(values), SLICE_BLOCKS):
        data, end = code_blocks(values[first : first + SLICE_BLOCKS], numbers[first : first + SLICE_BLOCKS], _codes[0])
        coded.append(data)
        ends.append(end + base)
        base += len(data)
    data, ends = np.concatenate(coded), np.concatenate(ends)
    out, block = [], 0
    for n, spare in zip(counts, spares):
        out.append(b"".join((header(n), data[ends[block] : ends[block + n + spare]].tobytes(), b"\xff\xd9")))
        block += n + spare
    return out


def encode_payload(payload: bytes) -> bytes:
    return encode_payloads([payload])[0]


# ---------------------------------------------------------------- parsing


@dataclass
class Component:
    id: int
    h: int
    v: int
    quantiser: int


@dataclass
class Scan:
    """One scan: the components in it with their tables, where its data stands and its restart interval."""

    components: list[tuple[int, int, int]]
    tables: dict[int, np.ndarray]
    interval: int
    data: np.ndarray  # without stuffing and markers
    starts: np.ndarray  # of each restart interval in ``data``


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)

    @property
    def most(self) -> tuple[int, int]:
        return max(c.h for c in self.components), max(c.v for c in self.components)

    def blocks(self, c: Component) -> tuple[int, int]:
        """Blocks of a component, across and down, as a scan of its own has them."""
        h, v = self.most
        return -(-(-(-self.width * c.h // h)) // 8), -(-(-(-self.height * c.v // v)) // 8)

    def mcus(self) -> tuple[int, int]:
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_tables: dict[bytes, np.ndarray] = {}


def cached_table(counts: bytes, symbols: bytes) -> np.ndarray:
    key = counts + symbols
    if key not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[key] = lookup_table(list(counts), symbols)
    return _tables[key]


def entropy_data(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Data of a scan without stuffing and restart markers, the starts of its intervals, and the bytes of the file it takes."""
    at = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[at + 1]
    ends = at[(following != 0) & (following != 0xFF) & ((following < 0xD0) | (following > 0xD7))]
    length = int(ends[0]) if len(ends) else len(raw)
    at, following = at[at < length], following[at < length]
    restart = at[(following >= 0xD0) & (following <= 0xD7)]
    keep = np.ones(length, bool)
    stuffed = at[following == 0] + 1
    keep[stuffed[stuffed < length]] = False
    keep[at[following == 0xFF]] = False
    keep[restart] = False
    keep[np.minimum(restart + 1, length - 1)] = False
    kept = np.zeros(length + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return raw[:length][keep], np.r_[0, kept[restart]], length


def parse(data: bytes) -> Picture:
    """Reads the markers of a baseline JPEG file; raises ValueError if it is none."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    picture, huffman, interval, at = Picture(), {}, 0, 2
    whole = np.frombuffer(data, np.uint8)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            picture.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                picture.quantisers[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            picture.height, picture.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            picture.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = cached_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            index = {c.id: i for i, c in enumerate(picture.components)}
            own = [(index[body[k]], body[k + 1] >> 4, 0x10 | body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            cleared, starts, used = entropy_data(whole[at:])
            picture.scans.append(Scan(own, dict(huffman), interval, cleared, starts))
            at += used
    if not picture.components or not picture.scans:
        raise ValueError("no picture in the file")
    return picture


# ---------------------------------------------------------------- decoding


def decode_lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, tables: np.ndarray, plan: np.ndarray, predictors: int, dc_only: bool) -> np.ndarray:
    """Coefficients of restart intervals, all read side by side.

    ``starts``: first byte of each interval; ``blocks``: how many blocks each has;
    ``plan``: for each block of a unit its DC table, AC table and predictor;
    ``tables``: the lookup tables. Gives one row a block, 64 wide or 1 if
    ``dc_only``, the intervals one after another.
    """
    data = np.r_[data, np.zeros(8, np.uint8)]
    windows = np.zeros(len(data) - 4, np.uint64)
    for k in range(5):
        windows = windows << np.uint64(8) | data[k : len(data) - 4 + k].astype(np.uint64)
    windows = windows.view(np.int64)
    most = len(windows) - 1
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    out = np.zeros((int(first[-1]), 1 if dc_only else 64), np.int16)
    flat, wide = out.reshape(-1), out.shape[1]
    lane = np.flatnonzero(blocks > 0)
    bit, block, k = starts[lane] * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    left, row = blocks[lane].astype(np.int64), first[lane]
    before = np.zeros((len(lane), predictors), np.int64)
    unit = len(plan)
    alone = len(tables) == 2 and unit == 1
    while len(row):
        window = windows[np.minimum(bit >> 3, most)]
        peek = (window >> (24 - (bit & 7))) & 0xFFFF
        is_dc = k == 0
        some_dc = is_dc.any()
        if alone:
            entry = tables[1][peek] if not some_dc else tables[0][peek] if is_dc.all() else np.where(is_dc, tables[0][peek], tables[1][peek])
        else:
            own = plan[block % unit]
            entry = tables[np.where(is_dc, own[:, 0], own[:, 1]), peek]
        if not entry.all():
            raise ValueError("a code that no table has")
        symbol, size = entry & 255, entry & 15
        bit += entry >> 8
        if int(size.max()) > 11:
            raise ValueError("a coefficient of more than 11 bits")
        full = np.left_shift(1, size) - 1
        value = (windows[np.minimum(bit >> 3, most)] >> (40 - (bit & 7) - size)) & full
        bit += size
        value -= np.where(value << 1 <= full, full, 0)
        done = symbol == 0
        if some_dc:
            at = np.flatnonzero(is_dc)
            slot = np.zeros(len(at), np.int64) if alone else own[at, 2]
            value[at] += before[at, slot]
            before[at, slot] = value[at]
            done &= ~is_dc
            k += np.where(is_dc, 0, symbol >> 4)
            put = (size > 0) | is_dc
        else:
            k += symbol >> 4
            put = size > 0
        put &= k < 64
        if not dc_only:
            flat[(row * wide + k)[put]] = value[put]
        elif some_dc:
            flat[row[is_dc]] = value[is_dc]
        k += 1
        over = done | (k >= 64)
        if over.any():
            k[over] = 0
            block[over] += 1
            row[over] += 1
            left[over] -= 1
            if not left.all():
                go = left > 0
                bit, block, k, left, row, before = bit[go], block[go], k[go], left[go], row[go], before[go]
    return out


def scan_blocks(picture: Picture, scan: Scan) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The plan of a unit, the blocks of each interval, and for each block of a unit its component and place in the unit."""
    if len(scan.components) == 1:
        i, dc, ac = scan.components[0]
        across, down = picture.blocks(picture.components[i])
        units, cells = across * down, [(i, 0, 0)]
        named = [(dc, ac, 0)]
    else:
        across, down = picture.mcus()
        units, cells, named = across * down, [], []
        for slot, (i, dc, ac) in enumerate(scan.components):
            c = picture.components[i]
            cells += [(i, y, x) for y in range(c.v) for x in range(c.h)]
            named += [(dc, ac, slot)] * (c.h * c.v)
    step = scan.interval or units
    intervals = -(-units // step)
    counts = np.full(intervals, step, np.int64)
    counts[-1] = units - step * (intervals - 1)
    if len(scan.starts) < intervals:
        raise ValueError("restart intervals are missing")
    return np.array(named), counts * len(cells), cells


@dataclass
class Lanes:
    """What decoding needs of one scan."""

    names: list[int]
    plan: np.ndarray
    counts: np.ndarray
    cells: list[tuple[int, int, int]]
    scan: Scan

    @classmethod
    def of(cls, picture: Picture, scan: Scan) -> Lanes:
        named, counts, cells = scan_blocks(picture, scan)
        names = sorted({int(x) for x in named[:, :2].ravel()})
        return cls(names, np.array([[names.index(a), names.index(b), s] for a, b, s in named.tolist()]), counts, cells, scan)

    @property
    def alike(self) -> tuple:
        """Scans that agree in this can be read together."""
        return tuple(id(self.scan.tables[x]) for x in self.names), self.plan.tobytes()


def coefficients(all_lanes: list[Lanes], dc_only: bool) -> list[np.ndarray]:
    """The blocks of each scan; scans with the same tables are read side by side."""
    out: list[np.ndarray | None] = [None] * len(all_lanes)
    groups: dict[tuple, list[int]] = {}
    for i, lanes in enumerate(all_lanes):
        groups.setdefault(lanes.alike, []).append(i)
    for members in groups.values():
        one = all_lanes[members[0]]
        tables = np.stack([one.scan.tables[x] for x in one.names])
        sizes = [len(all_lanes[i].scan.data) for i in members]
        data = np.concatenate([all_lanes[i].scan.data for i in members])
        starts = np.concatenate([all_lanes[i].scan.starts[: len(all_lanes[i].counts)] + base for i, base in zip(members, np.cumsum([0, *sizes[:-1]]).tolist())])
        counts = np.concatenate([all_lanes[i].counts for i in members])
        blocks = []
        for k in range(0, len(counts), LANES):
            begin, end = int(starts[k]), int(starts[k + LANES]) if k + LANES < len(starts) else len(data)
            blocks.append(decode_lanes(data[begin:end], starts[k : k + LANES] - begin, counts[k : k + LANES], tables, one.plan, len(one.scan.components), dc_only))
        done, at = np.concatenate(blocks), 0
        for i in members:
            n = int(all_lanes[i].counts.sum())
            out[i], at = done[at : at + n], at + n
    return out


def luminance_thumbnail(picture: Picture) -> np.ndarray:
    """The DC-only thumbnail of the first component: a pixel for each 8 x 8 block, cut to the picture."""
    for scan in picture.scans:
        if any(i == 0 for i, _, _ in scan.components):
            lanes = Lanes.of(picture, scan)
            return thumbnail_of(picture, scan, coefficients([lanes], True)[0], lanes.cells)
    raise ValueError("no scan of the first component")


def thumbnail_of(picture: Picture, scan: Scan, blocks: np.ndarray, cells: list[tuple[int, int, int]]) -> np.ndarray:
    c = picture.components[0]
    across, down = picture.blocks(c)
    step = int(picture.quantisers[c.quantiser][0])
    dc = blocks[:, 0].astype(np.int64).reshape(-1, len(cells))
    if len(scan.components) == 1:
        grid = dc[: across * down, 0].reshape(down, across)
    else:
        wide, high = picture.mcus()
        grid = np.zeros((high * c.v, wide * c.h), np.int64)
        for k, (i, y, x) in enumerate(cells):
            if i == 0:
                grid[y :: c.v, x :: c.h] = dc[: wide * high, k].reshape(high, wide)
    # the DC term is eight times the block's mean, less 128
    return np.clip((grid[:down, :across] * step + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 areas of the thumbnail is lighter than their mean."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)
    columns = np.linspace(0, thumbnail.shape[1], 9).astype(int)
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumbnail.astype(np.int64).cumsum(0).cumsum(1)
    top, left = np.minimum(rows[:-1], thumbnail.shape[0] - 1), np.minimum(columns[:-1], thumbnail.shape[1] - 1)
    bottom, right = np.maximum(rows[1:], top + 1), np.maximum(columns[1:], left + 1)
    areas = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    means = areas / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits(means.ravel() > means.mean()).tobytes().hex()


def thumbnail_feature(picture: Picture, thumbnail: np.ndarray) -> str:
    return f"{picture.width}x{picture.height} {average_hash(thumbnail)} {hashlib.sha256(thumbnail.tobytes()).hexdigest()[:16]}"


def decode_payloads(pictures: list[Picture]) -> list[tuple[bytes, np.ndarray]]:
    """For each file the bytes that ``encode_payloads`` stored, and the thumbnail."""
    lanes, stated = [], []
    for picture in pictures:
        said = next((x for x in picture.comments if x.startswith(b"payload ")), None)
        if said is None:
            raise ValueError("the file holds no payload")
        stated.append(int(said.split()[1]))
        lanes.append(Lanes.of(picture, picture.scans[0]))
    return [
        ((blocks[: n // 64] + 128).astype(np.uint8).tobytes(), thumbnail_of(picture, own.scan, blocks, own.cells))
        for picture, own, n, blocks in zip(pictures, lanes, stated, coefficients(lanes, False))
    ]


# ---------------------------------------------------------------- columns


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, a JPEG file that holds the bytes of the whole text (null: none), padded.

    Equal texts give equal files. Rows are handled one by one where they are read; a null doc_id stays null, an
    empty table gives no rows, other columns are not looked at. A long text is one picture, so it takes some ten times its bytes in its task.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            for doc_id, text, media in zip(batch.column("doc_id").to_pylist(), texts, encode_payloads([padded(x) for x in texts])):
                rows.add((doc_id, len(text), media), len(media))
            yield rows.take()

    return source.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the files of ``store_media`` back: checksums of the payload and of the file, dimensions and thumbnail hashes.

    One row a file, repeated ones too; an empty table gives no rows. A file that is null or not whole raises.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(out)
        for batch in pieces(batches, "media", 2 << 20):
            doc_ids, sizes, files = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            pictures = [parse(x) for x in files]
            for doc_id, n_bytes, data, picture, (payload, thumbnail) in zip(doc_ids, sizes, files, pictures, decode_payloads(pictures)):
                rows.add((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), thumbnail_feature(picture, thumbnail), picture.width, picture.height), 300)
            yield rows.take()

    return media.mapInArrow(read, schema)


def thumbnails(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with width, height, the DC-only thumbnail (rows of pixels), its hash and an error for each JPEG file of ``column``.

    A null or a file that is no baseline JPEG has nulls and the reason in ``media_error``. Repeated rows are
    handled each for itself, an empty table gives no rows, and columns of the added names are replaced.
    """
    media = media.drop("media_width", "media_height", "thumbnail", "thumbnail_width", "thumbnail_hash", "media_error")
    added = StructType.fromDDL("media_width int, media_height int, thumbnail binary, thumbnail_width int, thumbnail_hash string, media_error string")
    plain, fields = numbered(media, column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            made = []
            for data in batch.column(column).to_pylist():
                try:
                    picture = parse(data or b"")
                    small = luminance_thumbnail(picture)
                    made.append((picture.width, picture.height, small.tobytes(), small.shape[1], average_hash(small), None))
                except (ValueError, IndexError, KeyError) as error:
                    made.append((None,) * 5 + (str(error),))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.string())
            columns = [*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*made), kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added.names])

    return plain.mapInArrow(read, StructType([*fields, *added])).toDF(*media.columns, *added.names)
