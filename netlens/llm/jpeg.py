"""Baseline JPEG in numpy: a coefficient-exact writer, and a reader that decodes many scans at once.

Both work on many restart segments in step: each is independent, so a segment is a lane of
numpy arrays, and one step codes one symbol of every lane. An image without restart markers is
one lane. The reader takes any baseline image (8-bit samples, Huffman coding, one interleaved
scan or a single component, any sampling factors and restart interval). What a file claims is checked
before anything of its size is made: an image has no more blocks than its scan's bits can code.
"""

import numpy as np

BLOCK = 64

# Markers.
SOI, EOI, SOS, DQT, DHT, DRI, SOF0, COM, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xFE, 0xD0
OTHER_FRAMES = {*range(0xC1, 0xD0)} - {0xC4, 0xC8, 0xCC}


def canonical(counts: list[int], symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a Huffman table given as counts of lengths 1 to 16 and symbols in order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, length, code))
            code += 1
        at += n
        code <<= 1
    return out


def by_lengths(lengths: dict[int, int]) -> tuple[list[int], bytes]:
    """Counts and symbols of a table with the given code length of each symbol."""
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


# Code lengths of the writer. DC: sizes 0 to 11. AC: sizes without a run, those of lower-case letters shortest; then end of block and the 16-zero run.
DC_LENGTHS = dict.fromkeys(range(12), 4)
AC_LENGTHS = {5: 2, 4: 2, 7: 3, 3: 3, 6: 4, 8: 5, 2: 6, 1: 7, 0x00: 8, 0xF0: 9}
DC_TABLE, AC_TABLE = by_lengths(DC_LENGTHS), by_lengths(AC_LENGTHS)


def _codes(table: tuple[list[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, length, code in canonical(*table):
        codes[symbol], lengths[symbol] = code, length
    return codes, lengths


SIZE_OF = np.array([n.bit_length() for n in range(2048)], np.int64)
DC_CODES, AC_CODES = _codes(DC_TABLE), _codes(AC_TABLE)


def encode_segments(coefficients: np.ndarray, segment: np.ndarray, components: int) -> list[bytes]:
    """Entropy-coded bytes of each restart segment, stuffed.

    ``coefficients``: blocks of 64 in zigzag order without zeros past the first, the components
    in turn. ``segment``: the segment of each block, from 0 without gaps.
    """
    values = coefficients.astype(np.int64)
    n = len(values)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    dc = values[:, 0].copy()
    dc[components:] -= values[:-components, 0]
    for k in range(components):
        dc[first + k] = values[first + k, 0]
    values[:, 0] = dc
    size = SIZE_OF[np.abs(values)]
    codes, lengths = AC_CODES[0][size], AC_CODES[1][size]
    codes[:, 0], lengths[:, 0] = DC_CODES[0][size[:, 0]], DC_CODES[1][size[:, 0]]
    words = (codes << size | np.where(values < 0, values + (1 << size) - 1, values)).ravel()
    lengths = (lengths + size).ravel()
    ends = np.cumsum(lengths)
    bits_before = np.r_[0, ends[np.r_[first[1:], n] * BLOCK - 1]]
    n_bytes = (np.diff(bits_before) + 7) // 8
    byte_start = np.r_[0, np.cumsum(n_bytes)]
    shift = np.repeat(8 * byte_start[:-1] - bits_before[:-1], np.diff(np.r_[first, n]) * BLOCK)
    at = ends - lengths + shift
    word = at >> 5
    placed = words.astype(np.uint64) << (64 - (at & 31) - lengths).astype(np.uint64)
    begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros((int(byte_start[-1]) + 3) // 4 + 2, np.uint64)
    out[word[begins]] = np.add.reduceat(placed >> np.uint64(32), begins)
    last = np.r_[begins[1:], len(word)] - 1
    out[word[last] + 1] += placed[last] & np.uint64(0xFFFFFFFF)
    data = out.astype(">u4").view(np.uint8)
    pad = 8 * n_bytes - np.diff(bits_before)
    data[byte_start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(byte_start[:-1], byte_start[1:], strict=True)]


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def header(width: int, height: int, components: int, restart: int, comment: bytes) -> bytes:
    """All that precedes the scan data: quantisation by 1 for all but DC, by 8 for DC."""
    tables = b"".join(bytes([kind << 4]) + bytes(counts) + symbols for kind, (counts, symbols) in enumerate((DC_TABLE, AC_TABLE)))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([components]) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(components))
    scan = bytes([components]) + b"".join(bytes([k + 1, 0]) for k in range(components)) + bytes([0, 63, 0])
    return b"".join([b"\xff\xd8", _marker(COM, comment), _marker(DQT, bytes([0, 8] + [1] * 63)), _marker(SOF0, frame), _marker(DHT, tables), _marker(DRI, restart.to_bytes(2, "big")), _marker(SOS, scan)])


def joined(head: bytes, segments: list[bytes]) -> bytes:
    """The file: segments with restart markers in turn between them."""
    parts = [head]
    for k, s in enumerate(segments):
        if k:
            parts.append(bytes([0xFF, RST0 + (k - 1) % 8]))
        parts.append(s)
    parts.append(b"\xff\xd9")
    return b"".join(parts)


class Image:
    """What the markers of a baseline file say; ``segments`` holds the scan data, unstuffed."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.restart, self.quant, self.huffman = b"", 0, {}, {}
        self.width = 0
        at = 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if len(data) < at + 4 or data[at] != 0xFF:
                raise ValueError("broken marker")
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == COM:
                self.comment = body
            elif kind == DQT:
                self._quant(body)
            elif kind == DHT:
                self._huffman(body)
            elif kind == DRI:
                self.restart = int.from_bytes(body[:2], "big")
            elif kind == SOF0:
                self._frame(body)
            elif kind in OTHER_FRAMES:
                raise ValueError("not baseline")
            elif kind == SOS:
                break
        if not self.width or not self.height:
            raise ValueError("no frame")
        self._scan(body)
        self._data(data, at)

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = BLOCK * (1 + wide)
            if wide > 1 or len(body) <= n:
                raise ValueError("broken quantisation table")
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = sum(counts)
            if len(body) < 17 + n:
                raise ValueError("broken Huffman table")
            self.huffman[body[0]] = (tuple(counts), body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("not 8-bit")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        if not 1 <= len(self.parts) <= 4 or len(self.parts) != body[5] or not all(1 <= n <= 4 for h, v, _ in self.parts.values() for n in (h, v)):
            raise ValueError("broken sampling")
        self.most = max(h for h, _, _ in self.parts.values()), max(v for _, v, _ in self.parts.values())

    def _scan(self, body: bytes) -> None:
        """``blocks``: (component's place, DC table, AC table) of each block of an MCU."""
        scanned = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
        self.first = scanned[0][0]
        h0, v0, _ = self.parts[self.first]
        if len(scanned) == 1:
            self.grid = -(-self.width * h0 // (8 * self.most[0])), -(-self.height * v0 // (8 * self.most[1]))
            shape = [(1, 1)]
        elif len(scanned) == len(self.parts):
            self.grid = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
            shape = [self.parts[c][:2] for c, _ in scanned]
        else:
            raise ValueError("several scans")
        self.shape = shape[0]
        self.blocks = tuple((k, self.huffman[t >> 4], self.huffman[16 | t & 15]) for k, ((_, t), (h, v)) in enumerate(zip(scanned, shape, strict=True)) for _ in range(h * v))
        self.mcus = self.grid[0] * self.grid[1]
        if len({c for c, _ in scanned}) != len(scanned) or self.parts[self.first][2] not in self.quant:
            raise ValueError("broken scan")

    def _data(self, data: bytes, at: int) -> None:
        end = at
        while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or RST0 <= data[end + 1] < RST0 + 8 or data[end + 1] == 0xFF):
            end += 1 + (data[end + 1] != 0xFF)
        scan = data[at : end if end >= 0 else len(data)]
        # A block has two codes of one bit at least.
        if self.mcus * len(self.blocks) > 4 * len(scan):
            raise ValueError("more blocks than the scan can hold")
        parts, start, k = [], 0, 0
        if self.restart:
            while (found := scan.find(bytes([0xFF, RST0 + k % 8]), start)) >= 0:
                parts.append(scan[start:found])
                start, k = found + 2, k + 1
        parts.append(scan[start:])
        self.segments = [p.replace(b"\xff\x00", b"\xff") for p in parts]
        if len(self.segments) != (-(-self.mcus // self.restart) if self.restart else 1):
            raise ValueError("segments are missing")

    def lane_mcus(self) -> list[int]:
        if not self.restart:
            return [self.mcus]
        return [min(self.restart, self.mcus - k) for k in range(0, self.mcus, self.restart)]


#: Look-up tables of a worker, at most so many.
MOST_TABLES = 32
_luts: dict = {}


def _lut(table: tuple) -> np.ndarray:
    """For each next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    if table not in _luts:
        lut = np.zeros(1 << 16, np.int64)
        for symbol, length, code in canonical(list(table[0]), table[1]):
            lut[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        if len(_luts) >= MOST_TABLES:
            _luts.clear()
        _luts[table] = lut
    return _luts[table]


def decode(images: list[Image], kept: int = BLOCK) -> list[np.ndarray | None]:
    """The first ``kept`` coefficients of each block of each image: (blocks, kept) in zigzag order, DC values summed up;
    None where the data are broken.

    The images must have the same ``blocks``.
    """
    blocks = images[0].blocks
    per = len(blocks)
    tables = list(dict.fromkeys(t for _, dc, ac in blocks for t in (dc, ac)))
    luts = np.concatenate([_lut(t) for t in tables])
    dc_table = np.array([tables.index(dc) for _, dc, _ in blocks], np.int64) << 16
    ac_table = np.array([tables.index(ac) for _, _, ac in blocks], np.int64) << 16
    component = np.array([k for k, _, _ in blocks], np.int64)
    segments = [s for image in images for s in image.segments]
    n_blocks = np.array([per * m for image in images for m in image.lane_mcus()], np.int64)
    sizes = np.array([len(s) for s in segments], np.int64)
    flat = np.frombuffer(b"".join(s + b"\0" * 8 for s in segments) + b"\0" * 8, np.uint8).astype(np.int64)
    window = flat[:-4] << 32
    for k, shift in ((1, 24), (2, 16), (3, 8)):
        window |= flat[k : len(flat) - 4 + k] << shift
    window |= flat[4:]
    starts = np.r_[0, np.cumsum(sizes + 8)[:-1]]
    first_block = np.r_[0, np.cumsum(n_blocks)[:-1]]
    out = np.zeros(int(n_blocks.sum()) * kept, np.int16)
    bad = np.zeros(len(segments), bool)
    # Lanes by number of blocks, so that those still running are always a front part.
    lane = np.argsort(-n_blocks, kind="stable")
    bit, limit = starts[lane] * 8, (starts[lane] + sizes[lane]) * 8
    left, base = n_blocks[lane], first_block[lane] * kept
    turn, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    predicted = np.zeros((int(component.max()) + 1, len(lane)), np.int64)
    rows = np.arange(len(lane))
    while len(lane):
        is_dc = k == 0
        loaded = window[bit >> 3]
        offset = bit & 7
        table = np.where(is_dc, dc_table[turn], ac_table[turn])
        entry = luts[table + (loaded >> (24 - offset) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 255
        size = np.where(is_dc, symbol, symbol & 15)
        used = length + size
        raw = loaded >> (40 - offset - used) & ((1 << size) - 1)
        value = np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)
        bit += used
        at = np.minimum(np.where(is_dc, 0, k + (symbol >> 4)), 63)
        some = size > 0
        if is_dc.any():
            dcs = rows[: len(lane)][is_dc]
            predicted[component[turn[dcs]], dcs] += value[dcs] * some[dcs]
            value[dcs] = predicted[component[turn[dcs]], dcs]
            some |= is_dc
        held = some & (at < kept)
        out[(base + at)[held]] = value[held]
        ended = ~is_dc & ~some & (symbol != 0xF0)
        k = np.where(is_dc, 1, np.where(some, at + 1, np.where(ended, BLOCK, k + 16)))
        broken = (length == 0) | (bit > limit) | (size > 11)
        done = k >= BLOCK
        if done.any():
            base[done] += kept
            left[done] -= 1
            turn[done] = (turn[done] + 1) % per
            k[done] = 0
        if broken.any():
            bad[lane[broken]] = True
            left[broken] = 0
        if (left == 0).any():
            go = left > 0
            lane, bit, limit, left, base, turn, k = (x[go] for x in (lane, bit, limit, left, base, turn, k))
            predicted = predicted[:, go]
    found, seg, at = [], 0, 0
    for image in images:
        n = image.mcus * per
        found.append(None if bad[seg : seg + len(image.segments)].any() else out[at * kept : (at + n) * kept].reshape(n, kept))
        seg += len(image.segments)
        at += n
    return found


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance at one pixel for each block of the first component, from its DC alone."""
    h, v = image.shape
    per = len(image.blocks)
    luma = coefficients[:, 0].reshape(image.mcus, per)[:, : h * v].astype(np.int64)
    pixels = np.clip((luma * image.quant[image.parts[image.first][2]][0] + 4 >> 3) + 128, 0, 255)
    columns, rows = image.grid
    return pixels.reshape(rows, columns, v, h).swapaxes(1, 2).reshape(rows * v, columns * h).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> str:
    """64 bits, whether each of 8 by 8 areas is lighter than their mean, as hex."""
    small = pixels.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n < 8:
            small = np.take(small, np.arange(8) * n // 8, axis=axis)
        else:
            edges = np.arange(9) * n // 8
            small = np.add.reduceat(small, edges[:-1], axis=axis) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(small > small.mean()).tobytes().hex()
