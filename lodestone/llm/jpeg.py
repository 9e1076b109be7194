"""Progressive JPEG in numpy: a batch decoder, and an encoder that keeps bytes.

The decoder takes any 8-bit progressive file of one or three components with
Huffman coding: it accumulates spectral-selection and successive-approximation
scans into coefficient arrays, inverse-transforms them, upsamples chroma and
gives RGB. Entropy-coded segments are cut at restart markers and all intervals
of all frames of a batch that share scan parameters advance in lockstep.

The encoder stores arbitrary bytes losslessly: a block of 64 bytes is one 8x8
block whose quantised coefficients are the bytes (DC: 256 + byte; AC: the
signed value whose eight magnitude bits are the byte). Bytes go to Y, Cb and Cr
of 4:2:0 frames, coded in the scans of ``SCANS`` with one block a restart
interval.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

FRAME_BYTES = 1 << 18
#: Ss, Se, Ah, Al of the scans of every component.
SCANS = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """64 x 64: from zigzag coefficients to samples in raster order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(c, c)[ZIGZAG]


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def _intervals(bits: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes with stuffing and a restart marker after every row, and the end offset of every row (before its marker)."""
    pad = -bits.shape[1] % 8
    if pad:
        bits = np.concatenate([bits, np.ones((len(bits), pad), bits.dtype)], 1)
    packed = np.packbits(bits, axis=1)
    rows = np.concatenate([packed, np.full((len(bits), 1), 0xFF, np.uint8), (0xD0 + number % 8).astype(np.uint8)[:, None]], 1)
    stuff = rows == 0xFF
    stuff[:, -2:] = False
    ends = np.cumsum(rows.shape[1] + stuff.sum(1)) - 2
    flat, times = rows.ravel(), 1 + stuff.ravel()
    out = np.repeat(flat, times)
    out[np.cumsum(times)[stuff.ravel()] - 1] = 0
    return out, ends


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values (..., n) as n fields of one zero code bit and ``width`` bits each."""
    shift = np.arange(width, -1, -1, dtype=np.uint8)
    field_bits = (values[..., None] >> shift) & 1
    field_bits[..., 0] = 0
    return field_bits.reshape(len(values), -1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stored form per payload (a positive multiple of 64 bytes): frames of at most FRAME_BYTES one after another."""
    frames = [(i, p[at : at + FRAME_BYTES]) for i, p in enumerate(payloads) for at in range(0, len(p), FRAME_BYTES)]
    mcus = np.array([-(-len(p) // 384) for _, p in frames], np.int64)
    data = np.zeros((mcus.sum() * 6, 64), np.uint8)
    first = np.append(0, np.cumsum(mcus * 6))
    flat = data.reshape(-1)
    for (_, p), at in zip(frames, first[:-1], strict=True):
        flat[at * 64 : at * 64 + len(p)] = np.frombuffer(p, np.uint8)
    # components of a frame are runs of its blocks: 4, 1 and 1 of every 6
    begin = np.stack([first[:-1], first[:-1] + 4 * mcus, first[:-1] + 5 * mcus, first[1:]], 1)
    run_at = begin[:, :3].ravel()
    run_n = np.diff(begin, axis=1).ravel()
    number = np.arange(len(data)) - np.repeat(run_at, run_n)
    magnitude = np.where(data >= 128, data, 255 - data)
    streams = []
    for ss, se, ah, al in SCANS:
        if se == 0 and ah:
            streams.append((data[:, 0] & 1, None))
        elif se == 0:
            streams.append(_intervals(_bits((data[:, :1] >> 1) | 128, 8), number))
        elif not ah:
            streams.append(_intervals(_bits(data[:, ss : se + 1] >> al, 6), number))
        else:
            bits = np.zeros((len(data), 64), np.uint8)
            bits[:, 1:] = (magnitude[:, 1:] >> al) & 1
            streams.append(_intervals(bits, number))
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
    tables = _table(0, 0, 8) + _table(1, 0, 6) + _table(1, 1, 0)
    out: list[list[bytes]] = [[] for _ in payloads]
    for f, (i, p) in enumerate(frames):
        part = out[i]
        part += [head, _segment(0xC2, struct.pack(">BHHB", 8, 16, 16 * int(mcus[f]), 3) + b"\1\x22\0\2\x11\0\3\x11\0"), tables, _segment(0xFE, struct.pack(">Q", len(p)))]
        for k, (ss, se, ah, al) in enumerate(SCANS):
            stream, ends = streams[k]
            if k in _INTERVALS:
                part.append(_INTERVALS[k])
            for c in range(3):
                a, b = begin[f, c], begin[f, c + 1]
                part.append(_HEADS[k][c])
                if ends is None:
                    n = b - a
                    raw = np.packbits(np.append(stream[a:b], np.ones(-n % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\0")
                else:
                    raw = stream[(ends[a - 1] + 2 if a else 0) : ends[b - 1]].tobytes()
                part.append(raw)
        part.append(b"\xff\xd9")
    return [b"".join(x) for x in out]


#: Restart interval segments before the scans at which it changes, and scan headers by component.
_INTERVALS = {k: _segment(0xDD, struct.pack(">H", int(not raw))) for k, raw in enumerate([x[1] == 0 and x[2] > 0 for x in SCANS]) if k == 0 or raw or SCANS[k - 1][1] == 0 and SCANS[k - 1][2] > 0}
_HEADS = [[_segment(0xDA, bytes([1, c + 1, 1 if ah and se else 0, ss, se, ah << 4 | al])) for c in range(3)] for ss, se, ah, al in SCANS]


@dataclass
class Component:
    ident: int
    h: int
    v: int
    q: int
    wide: int = 0  # blocks a row, padded to whole units
    high: int = 0
    real_wide: int = 0  # blocks a row in scans of this component alone
    real_high: int = 0
    at: int = 0  # first row in the coefficient array


@dataclass
class Scan:
    parts: list[int]
    ss: int
    se: int
    ah: int
    al: int
    dri: int
    tables: tuple
    start: int
    end: int


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    image: int = 0
    blocks: int = 0


def parse(data: bytes, stops: np.ndarray, base: int, end: int, image: int) -> list[Frame]:
    """Frames between ``base`` and ``end``; ``stops`` are the places of markers that end entropy-coded data."""
    frames, p = [], base
    huff: dict[tuple[int, int], bytes] = {}
    f, dri = Frame(), 0
    while p + 1 < end:
        marker = data[p + 1]
        if marker == 0xD8:
            f, dri, huff, p = Frame(image=image), 0, {}, p + 2
            continue
        if marker == 0xD9:
            frames.append(f)
            p += 2
            continue
        (size,) = struct.unpack_from(">H", data, p + 2)
        body, p = data[p + 4 : p + 2 + size], p + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 129 if wide else 65
                f.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.float64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            (dri,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xC2:
            precision, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit frames are read")
            f.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in f.parts), max(c.v for c in f.parts)
            units_w, units_h = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
            for c in f.parts:
                c.wide, c.high = units_w * c.h, units_h * c.v
                c.real_wide, c.real_high = -(-(-(-f.width * c.h // hm)) // 8), -(-(-(-f.height * c.v // vm)) // 8)
                c.at, f.blocks = f.blocks, f.blocks + c.wide * c.high
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman frame")
        elif marker == 0xDA:
            n = body[0]
            idents = [c.ident for c in f.parts]
            parts = [idents.index(body[1 + 2 * i]) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            tables = tuple(huff.get((1, body[2 + 2 * i] & 15) if ss else (0, body[2 + 2 * i] >> 4), b"") for i in range(n))
            stop = int(stops[np.searchsorted(stops, p)])
            f.scans.append(Scan(parts, ss, se, a >> 4, a & 15, dri, tables, p, stop))
            p = stop
    return frames


_LUTS: dict[bytes, np.ndarray] = {}


def lut(table: bytes) -> np.ndarray:
    """From 16 bits to length << 8 | symbol."""
    if table not in _LUTS:
        out, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                low = code << (16 - length)
                out[low : low + (1 << (16 - length))] = length << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LUTS[table] = out
    return _LUTS[table]


class Bits:
    """Unstuffed entropy-coded bytes of many intervals."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        d = np.append(data, np.zeros(1, np.uint8))
        ff = np.flatnonzero(d[:-1] == 0xFF)
        nxt = d[ff + 1]
        keep = np.ones(len(data), bool)
        keep[ff[nxt == 0] + 1] = False
        rst = ff[(nxt & 0xF8) == 0xD0]
        keep[rst] = keep[rst + 1] = False
        at = np.cumsum(keep) - keep
        plain = data[keep]
        self.starts = np.sort(np.append(np.append(at, keep.sum())[starts], np.append(at, keep.sum())[rst + 2])) * 8
        padded = np.append(plain, np.full(4, 0xFF, np.uint8)).astype(np.int32)
        self.window = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
        self.bits = np.unpackbits(np.append(plain, np.full(32, 0xFF, np.uint8)))

    def peek(self, pos: np.ndarray) -> np.ndarray:
        at = np.minimum(pos >> 3, len(self.window) - 1)
        return self.window[at] >> (8 - (pos & 7)) & 0xFFFF

    def take(self, pos: np.ndarray, n) -> np.ndarray:
        return self.peek(pos) >> (16 - n)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)


def _dc_first(coef, bits, pos, rows, which, luts, n_parts, al):
    pred = np.zeros((len(pos), n_parts), np.int64)
    for j in range(rows.shape[1]):
        on = np.flatnonzero(rows[:, j] >= 0)
        for c in range(n_parts):
            lane = on[which[on, j] == c] if n_parts > 1 else on
            if not len(lane):
                continue
            code = luts[c][bits.peek(pos[lane])]
            pos[lane] += code >> 8
            s = code & 255
            pred[lane, c] += np.where(s > 0, _extend(bits.take(pos[lane], s), s), 0)
            pos[lane] += s
            coef[rows[lane, j], 0] = pred[lane, c] << al


def _dc_refine(coef, bits, pos, rows, al):
    n = (rows >= 0).sum(1)
    lane = np.repeat(np.arange(len(rows)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    coef[rows[lane, j], 0] |= bits.bits[pos[lane] + j].astype(coef.dtype) << al


def _ac_first(coef, bits, pos, rows, table, ss, se, al):
    flat = coef.reshape(-1)
    eob = np.zeros(len(pos), np.int64)
    for j in range(rows.shape[1]):
        on = np.flatnonzero(rows[:, j] >= 0)
        skip = eob[on] > 0
        eob[on[skip]] -= 1
        lane = on[~skip]
        k, p, base = np.full(len(lane), ss), pos[lane], rows[lane, j] * 64
        run = np.zeros(len(lane), np.int64)
        live = np.arange(len(lane))
        whole = True
        while len(live):
            q = p if whole else p[live]
            code = table[bits.peek(q)]
            q = q + (code >> 8)
            s, r = code & 15, code >> 4 & 15
            kk = (k if whole else k[live]) + r
            value = bits.take(q, s)
            put = s > 0
            if put.all():
                flat[(base if whole else base[live]) + np.minimum(kk, 63)] = _extend(value, s) << al
            else:
                b = (base if whole else base[live])[put]
                flat[b + np.minimum(kk[put], 63)] = _extend(value[put], s[put]) << al
                end = ~put & (r < 15)
                run[live[end]] = (1 << r[end]) - 1 + np.where(r[end] > 0, bits.take(q[end], r[end]), 0)
                q = q + np.where(end, r, 0)
                kk = np.where(end, se, kk)
            q = q + s
            if whole:
                p, k = q, kk + 1
            else:
                p[live], k[live] = q, kk + 1
            over = (k if whole else k[live]) > se
            if over.any():
                live, whole = live[~over], False
        pos[lane], eob[lane] = p, run


def _ac_refine(coef, bits, pos, rows, table, ss, se, al):
    step, band = 1 << al, np.arange(ss, se + 1)
    eob = np.zeros(len(pos), np.int64)
    for j in range(rows.shape[1]):
        lane = np.flatnonzero(rows[:, j] >= 0)
        k = np.full(len(lane), ss)
        while len(lane):
            row = rows[lane, j]
            block = coef[row, ss : se + 1]
            p, known = pos[lane], block != 0
            ahead = band >= k[:, None]
            fresh = eob[lane] == 0
            code = np.where(fresh, table[bits.peek(p)], 0)
            s, r = code & 15, code >> 4 & 15
            p = p + (code >> 8)
            starts_eob = fresh & (s == 0) & (r < 15)
            eob[lane] = np.where(starts_eob, (1 << r) + np.where(r > 0, bits.take(p, r), 0), eob[lane])
            p = p + np.where(starts_eob, r, 0)
            whole = eob[lane] > 0
            sign = bits.take(p, 1)
            p = p + (s > 0)
            if whole.all():
                target = np.full(len(lane), se)
                reach = ahead
            else:
                zeros = np.cumsum(~known & ahead, axis=1)
                hit = zeros >= (r + 1)[:, None]
                target = np.where(whole | ~hit.any(1), se, ss + hit.argmax(1))
                reach = ahead & (band <= target[:, None])
            fix = known & reach
            rank = np.cumsum(fix, axis=1) - fix
            got = bits.bits[np.minimum(p[:, None] + rank, len(bits.bits) - 1)].astype(bool) & fix
            got &= (np.abs(block) & step) == 0
            block += np.where(got, np.where(block > 0, step, -step), 0).astype(block.dtype)
            p = p + fix.sum(1)
            new = np.flatnonzero((s > 0) & ~whole)
            if len(new):
                block[new, target[new] - ss] = np.where(sign[new] > 0, step, -step)
            coef[row, ss : se + 1] = block
            pos[lane] = p
            eob[lane] -= whole
            k = target + 1
            keep = k <= se
            lane, k = lane[keep], k[keep]


def _rows(f: Frame, s: Scan, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient rows and component numbers of a scan in coded order."""
    if len(s.parts) == 1:
        c = f.parts[s.parts[0]]
        rows = base + c.at + (np.arange(c.real_high)[:, None] * c.wide + np.arange(c.real_wide)).ravel()
        return rows, np.zeros(len(rows), np.int64)
    units_w, units_h = f.parts[0].wide // f.parts[0].h, f.parts[0].high // f.parts[0].v
    cells, which = [], []
    for n, i in enumerate(s.parts):
        c = f.parts[i]
        y = np.arange(units_h)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]
        x = np.arange(units_w)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :]
        cells.append((base + c.at + y * c.wide + x).reshape(units_w * units_h, -1))
        which.append(np.full(cells[-1].shape, n))
    return np.concatenate(cells, 1).ravel(), np.concatenate(which, 1).ravel()


def coefficients(images: list[bytes]) -> tuple[list[Frame], np.ndarray, np.ndarray]:
    """Frames of all images, the first block of each, and their accumulated coefficients (blocks x 64, zigzag order)."""
    joined = b"".join(images)
    data = np.frombuffer(joined, np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    nxt = data[ff + 1]
    stops = ff[(nxt != 0) & ((nxt & 0xF8) != 0xD0)]
    frames, at = [], 0
    for i, x in enumerate(images):
        frames += parse(joined, stops, at, at + len(x), i)
        at += len(x)
    base = np.append(0, np.cumsum([f.blocks for f in frames])).astype(np.int64)
    coef = np.zeros((base[-1], 64), np.int32)
    for ordinal in range(max((len(f.scans) for f in frames), default=0)):
        groups: dict[tuple, list[tuple[int, Scan]]] = {}
        for i, f in enumerate(frames):
            if ordinal < len(f.scans):
                s = f.scans[ordinal]
                groups.setdefault((len(s.parts), s.ss, s.se, s.ah, s.al, s.dri, s.tables), []).append((i, s))
        for (n_parts, ss, se, ah, al, dri, tables), members in groups.items():
            sizes = np.array([s.end - s.start for _, s in members])
            stream = np.concatenate([data[s.start : s.end] for _, s in members])
            bits = Bits(stream, np.cumsum(sizes) - sizes)
            plain = n_parts == 1 and all((c := frames[i].parts[s.parts[0]]).wide == c.real_wide for i, s in members)
            if plain:  # blocks of a component stand in coded order
                own = [(base[i] + (c := frames[i].parts[s.parts[0]]).at, c.real_wide * c.real_high) for i, s in members]
                at, n = np.array(own, np.int64).T
                rows = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                which, per = np.zeros(len(rows), np.int64), np.full(len(n), dri) if dri else n
            else:
                coded = [_rows(frames[i], s, base[i]) for i, s in members]
                rows, which = (np.concatenate(x) for x in zip(*coded, strict=True))
                n = np.array([len(r) for r, _ in coded])
                per = np.array([dri * (1 if n_parts == 1 else sum(frames[i].parts[c].h * frames[i].parts[c].v for c in s.parts)) for i, s in members]) if dri else n
            parts = -(-n // per)
            lanes = np.repeat(per, parts)
            lanes[np.cumsum(parts) - 1] = n - per * (parts - 1)
            wide = int(lanes.max())
            grid, kind = np.full((len(lanes), wide), -1, np.int64), np.zeros((len(lanes), wide), np.int64)
            filled = np.arange(wide) < lanes[:, None]
            grid[filled], kind[filled] = rows, which
            pos = bits.starts[: len(lanes)].astype(np.int64)
            if len(bits.starts) < len(lanes):
                raise ValueError("restart markers are missing")
            if ss == 0 and not ah:
                _dc_first(coef, bits, pos, grid, kind, [lut(t) for t in tables], n_parts, al)
            elif ss == 0:
                _dc_refine(coef, bits, pos, grid, al)
            elif not ah:
                _ac_first(coef, bits, pos, grid, lut(tables[0]), ss, se, al)
            else:
                _ac_refine(coef, bits, pos, grid, lut(tables[0]), ss, se, al)
    return frames, base, coef


def payloads(images: list[bytes], frames: list[Frame], base: np.ndarray, coef: np.ndarray) -> list[bytes]:
    """The bytes that ``encode`` stored, from the coefficients."""
    value = np.where(coef >= 0, coef, coef + 255)
    value[:, 0] = coef[:, 0] - 256
    value = value.astype(np.uint8)
    out: list[list[bytes]] = [[] for _ in images]
    for f, at, end in zip(frames, base[:-1], base[1:], strict=True):
        (n,) = struct.unpack(">Q", f.comment)
        out[f.image].append(value[at:end].tobytes()[:n])
    return [b"".join(x) for x in out]


def samples(frames: list[Frame], base: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Inverse transform of all blocks: blocks x 64 samples, raster order."""
    scaled = coef.astype(np.float64)
    for f, at in zip(frames, base[:-1], strict=True):
        for c in f.parts:
            if (q := f.quant[c.q]).any() and not (q == 1).all():
                scaled[at + c.at : at + c.at + c.wide * c.high] *= q
    return np.clip(np.floor(scaled @ BASIS + (128.5 + 1e-7)), 0, 255).astype(np.uint8)


def rgb(f: Frame, at: int, pixels: np.ndarray) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3) of a frame; chroma is replicated."""
    hm, vm = max(c.h for c in f.parts), max(c.v for c in f.parts)
    planes = []
    for c in f.parts:
        own = pixels[at + c.at : at + c.at + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
        if c.h < hm or c.v < vm:
            own = own.repeat(vm // c.v, 0).repeat(hm // c.h, 1)
        planes.append(own[: f.height, : f.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], 2) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)
