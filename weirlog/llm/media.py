"""AVI motion-JPEG: RIFF indexes, intra frames, and shots by adaptive histogram differences.

A media column holds AVI files whose frames are baseline JPEG images. The frames' entropy-coded
segments between restart markers are independent, so all segments of a batch are decoded in
lock-step, a block of each at a time. Shots are found on the DC image (the means of the 8x8 blocks
of the luminance), the usual compressed-domain picture for it.

`encode` stores bytes without loss: a sample is an 8x8 block of that grey value, whose only
coefficient is its DC term; with a quantiser of 8 this is exact in every baseline decoder.

Defined results: null media has no clips; media that cannot be parsed or decoded gives one row whose
`problem` says why; where the header counts other frames than were found, every clip's `problem` says so;
an AVI without frames has no clips; a frame whose difference ties with its neighbour's begins a shot as
well; a null text counts as empty when stored, and a text of any length is stored whole; repeated rows are
repeated; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import lean, ship, slices, text_or_empty

UNIT, FRAME_ROWS, FPS = 64, 16, 25
BINS, WINDOW, SIGMAS, FLOOR = 32, 6, 2.0, 0.08

# The code lengths and symbols of the standard's typical Huffman tables, and the zigzag's rule below.
DC_BITS = {0: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), 1: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)}
AC_BITS = {0: (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), 1: (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)}
AC_FIRST = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}


def _ac_symbols(table: int) -> bytes:
    """The listed symbols, then every other run and size in order."""
    first = bytes.fromhex(AC_FIRST[table].replace(" ", ""))
    return first + bytes(x for x in range(256) if 1 <= x & 15 <= 10 and x not in first)


def zigzag() -> np.ndarray:
    """Place in the 8x8 block of each coefficient in coded order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


class BadMedia(ValueError):
    """A file that is no readable motion-JPEG AVI."""


# --- RIFF ---


@dataclass
class Avi:
    """Frames are (offset, size) in the file."""

    width: int = 0
    height: int = 0
    fps: float = float(FPS)
    comment: bytes = b""
    frames: list[tuple[int, int]] = field(default_factory=list)
    total: int = 0
    problem: str | None = None


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise BadMedia(f"chunk {name!r} runs past its list")
        yield name, at + 8, n
        at += 8 + n + (n & 1)


def _walk(data: bytes, at: int, end: int):
    """Chunks of a movie list, those in record lists as well: name, offset, size."""
    for name, a, n in _chunks(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _walk(data, a + 4, a + n)
        else:
            yield name, a, n


def _indexed(data: bytes, at: int, n: int) -> list[tuple[int, int]]:
    """Frames of an index chunk: one of frames, or one of such indexes."""
    width, kind, entries = struct.unpack_from("<HxBI", data, at)
    if kind == 0:  # of indexes: 64-bit offset of each chunk, its size with the name, and its duration
        if width != 4 or 24 + 16 * entries > n:
            raise BadMedia("an index of indexes can't be read")
        out: list[tuple[int, int]] = []
        for i in range(entries):
            where, size, _ = struct.unpack_from("<QII", data, at + 24 + 16 * i)
            if where + 8 + 24 > len(data):
                raise BadMedia("the index points past the file")
            out += _indexed(data, where + 8, size - 8)
        return out
    if kind != 1 or width != 2 or 24 + 8 * entries > n or at + 24 + 8 * entries > len(data):
        raise BadMedia("an index can't be read")
    [base] = struct.unpack_from("<Q", data, at + 12)
    found = np.frombuffer(data, "<u4", 2 * entries, at + 24).reshape(-1, 2).astype(np.int64)
    # The highest bit of a size marks a frame that isn't a key frame.
    return [(base + int(o), int(m) & 0x7FFFFFFF) for o, m in found]


def parse_avi(data: bytes) -> Avi:
    """Header fields and frames of all RIFF parts.

    Frames come from the stream's own index if it has one, else the first part's from the old index; the movie lists
    themselves are walked where there is none or where it doesn't point at frames. An empty frame repeats the one before.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("not an AVI file")
    out, movies, old, own, counted, streams, start, files = Avi(), [], None, None, 0, 0, 0, 0
    video = None
    while data[start : start + 4] == b"RIFF" and data[start + 8 : start + 12] in (b"AVI ", b"AVIX"):
        end = start + 8 + int.from_bytes(data[start + 4 : start + 8], "little")
        for name, at, n in _chunks(data, start + 12, min(len(data), end)):
            kind = data[at : at + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for sub, a, m in _chunks(data, at + 4, at + n):
                    inner = data[a : a + 4] if sub == b"LIST" else b""
                    if sub == b"avih" and m >= 40:
                        micros, out.width, out.height = struct.unpack_from("<I", data, a)[0], *struct.unpack_from("<II", data, a + 32)
                        out.fps, counted = 1e6 / micros if micros else float(FPS), struct.unpack_from("<I", data, a + 16)[0]
                    elif inner == b"strl":
                        parts = {x: (b, k) for x, b, k in _chunks(data, a + 4, a + m)}
                        if video is None and data[parts.get(b"strh", (0, 0))[0] :][:4] == b"vids":
                            video, own = streams, parts.get(b"indx")
                        streams += 1
                    elif inner == b"odml":
                        # The main header counts the first part alone; this one counts all.
                        counted_all = [struct.unpack_from("<I", data, b)[0] for x, b, k in _chunks(data, a + 4, a + m) if x == b"dmlh" and k >= 4]
                        out.total = counted_all[0] if counted_all else out.total
            elif kind == b"INFO" and not out.comment:
                out.comment = next((data[a : a + m] for sub, a, m in _chunks(data, at + 4, at + n) if sub == b"ICMT"), b"").rstrip(b"\0")
            elif kind == b"movi":
                movies.append((files, at, n))
            elif name == b"idx1" and files == 0:
                old = np.frombuffer(data, "<u4", n // 16 * 4, at).reshape(-1, 4)
        files, start = files + 1, end + (end & 1)
    if not movies:
        raise BadMedia("no movie list")
    names = [b"%02d" % (video or 0) + x for x in (b"dc", b"db")]
    walked = lambda later: [(a, m) for file, at, n in movies if file >= later for name, a, m in _walk(data, at + 4, at + n) if name in names]
    is_frame = lambda o: data[o - 8 : o - 4] in names
    if own:
        out.frames = _indexed(data, *own)
    elif old is not None:
        mine = old[np.isin(old[:, 0], [int.from_bytes(x, "little") for x in names])].astype(np.int64)
        # Offsets count from the movie list's name, or from the file's start.
        base = movies[0][1] if not len(mine) or mine[0, 2] < movies[0][1] else 0
        out.frames = [(int(o) + base + 8, int(s)) for _, _, o, s in mine] + (walked(1) if files > 1 else [])
        if any(not is_frame(o) for o, _ in out.frames):
            out.frames = walked(0)
    else:
        out.frames = walked(0)
    if any(o + s > len(data) for o, s in out.frames):
        raise BadMedia("the index points past the file")
    for i, (_, s) in enumerate(out.frames):
        if not s and i:
            out.frames[i] = out.frames[i - 1]
    want = out.total or (counted if files == 1 else 0)
    if want and want != len(out.frames):
        out.problem = f"the header counts {want} frames, {len(out.frames)} were found"
    return out


def write_avi(frames: list[bytes], width: int, height: int, comment: bytes) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width if width < 32768 else 0, height if height < 32768 else 0)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"INFO" + chunk(b"ICMT", comment)) + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


# --- JPEG headers and Huffman tables ---


@dataclass(frozen=True)
class Layout:
    """What a frame's entropy-coded data needs: blocks of an MCU by component, their tables, and sizes."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quantisers: tuple[tuple[int, ...], ...]
    dc: tuple[tuple[bytes, bytes], ...]
    ac: tuple[tuple[bytes, bytes], ...]
    interval: int

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        if len(self.sampling) == 1:
            h = v = 1
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @property
    def blocks(self) -> tuple[int, ...]:
        """Component of each block of an MCU."""
        if len(self.sampling) == 1:
            return (0,)
        return tuple(c for c, (h, v) in enumerate(self.sampling) for _ in range(h * v))

    @property
    def tables(self):
        return self.blocks, self.dc, self.ac


def scan_start(frame: bytes) -> int:
    """Where the entropy-coded data begins."""
    if frame[:2] != b"\xff\xd8":
        raise BadMedia("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        n = frame[at + 2] << 8 | frame[at + 3]
        if frame[at + 1] == 0xDA:
            return at + 2 + n
        at += 2 + n
    raise BadMedia("a frame has no scan")


@lru_cache(256)
def layout(header: bytes) -> Layout:
    """Parsed from everything up to the scan. Tables that are absent are the standard's."""
    quant: dict[int, tuple[int, ...]] = {}
    huff = {(0, t): (bytes(DC_BITS[t]), bytes(range(12))) for t in (0, 1)} | {(1, t): (bytes(AC_BITS[t]), _ac_symbols(t)) for t in (0, 1)}
    shape, parts, interval, scan, at = None, {}, 0, [], 2
    while at + 4 <= len(header):
        kind, n = header[at + 1], header[at + 2] << 8 | header[at + 3]
        body = header[at + 4 : at + 2 + n]
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = tuple(np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).tolist())
                i += 1 + 64 * (1 + wide)
        elif kind in (0xC0, 0xC1):
            shape = struct.unpack_from(">HH", body, 1)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise BadMedia("only baseline frames are read")
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                total = sum(body[i + 1 : i + 17])
                huff[body[i] >> 4, body[i] & 15] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + total])
                i += 17 + total
        elif kind == 0xDD:
            interval = body[0] << 8 | body[1]
        elif kind == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        at += 2 + n
    if shape is None or len(scan) != len(parts) or any(c not in parts or parts[c][2] not in quant or (0, d) not in huff or (1, a) not in huff for c, d, a in scan):
        raise BadMedia("a frame's header is incomplete")
    return Layout(shape[1], shape[0], tuple(parts[c][:2] for c, _, _ in scan), tuple(quant[parts[c][2]] for c, _, _ in scan), tuple(huff[0, d] for _, d, _ in scan), tuple(huff[1, a] for _, _, a in scan), interval)


@lru_cache(16)
def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: code length << 8 | symbol; 0 where there is no code."""
    bits, symbols = table
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            a = code << (16 - length)
            out[a : a + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A coefficient from its extra bits."""
    half = np.int64(1) << np.maximum(size - 1, 0)
    return np.where(size == 0, 0, np.where(bits >= half, bits, bits - 2 * half + 1))


@lru_cache(16)
def plain_blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits, where they hold a whole block of a DC term alone: (value + 4096) << 8 | bits used; else 0."""
    word = np.arange(1 << 16, dtype=np.int64)
    entry = lookup(dc)
    length, size = entry >> 8, entry & 15
    used = length + size
    value = _value((word << length & 0xFFFF) >> (16 - size), size)
    end = lookup(ac)[(word << np.minimum(used, 16)) & 0xFFFF]
    whole = used + (end >> 8)
    ok = (length > 0) & (end > 0) & (end & 255 == 0) & (whole <= 16)
    return np.where(ok, value + 4096 << 8 | whole, 0)


# --- Entropy decoding, all segments at once ---


def segments(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all scans without stuffing and markers, the start of each restart segment in them, and segments by scan."""
    raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    start = np.concatenate(([0], np.cumsum([len(s) for s in scans]))).astype(np.int64)
    mark = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[mark + 1]
    keep = np.ones(len(raw), bool)
    keep[mark[after == 0] + 1] = False
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    other = mark[(after == 0xD9) | (after == 0xFF)]
    keep[restart] = keep[restart + 1] = False
    keep[other] = False
    keep[other[raw[other + 1] == 0xD9] + 1] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    begins = np.sort(np.concatenate((start[:-1], restart + 2)))
    of = np.searchsorted(start[:-1], begins, side="right") - 1
    return np.concatenate((raw[keep], np.zeros(16, np.uint8))), kept[begins], np.bincount(of, minlength=len(scans))


def decode_scans(scans: list[bytes], layouts: list[Layout], full: bool = False) -> list[np.ndarray]:
    """For each scan its DC terms by MCU and block, (mcus, blocks), or with `full` all coefficients, (mcus, blocks, 64) in coded order. All layouts share their tables."""
    blocks, dcs, acs = layouts[0].tables
    data, begins, parts = segments(scans)
    windows = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), strides=(1,))
    total = np.array([a * b for a, b in (x.mcus for x in layouts)])
    each = np.array([x.interval or n for x, n in zip(layouts, total.tolist(), strict=True)])
    if (parts != -(-total // each)).any():
        raise BadMedia("restart markers are missing")
    scan = np.repeat(np.arange(len(scans)), parts)
    place = np.arange(len(scan)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(each[scan], total[scan] - place * each[scan])
    most, per = int(count.max(initial=0)), len(blocks)
    out = np.zeros((len(scan), most, per, 64) if full else (len(scan), most, per), np.int16)
    bit = begins.astype(np.int64) * 8
    limit = len(data) * 8 - 96
    previous = np.zeros((len(scan), len(dcs)), np.int64)
    even = int(count.min(initial=0))
    plain = {c: plain_blocks(dcs[c], acs[c]) for c in set(blocks)}
    for m in range(most):
        live = slice(None) if m < even else np.flatnonzero(count > m)
        for b, c in enumerate(blocks):
            at = bit[live]
            word = (windows[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> np.uint64(48)
            entry = plain[c][word.astype(np.int64)]
            slow = np.flatnonzero(entry == 0)
            step = entry & 255
            if not len(slow):
                previous[live, c] += (entry >> 8) - 4096
                bit[live] = at + step
            else:
                quick = np.where(entry == 0, 0, (entry >> 8) - 4096)
                previous[live, c] += quick
                bit[live] = at + step
                lanes = slow if m < even else live[slow]
                _slow_block(windows, lookup(dcs[c]), lookup(acs[c]), bit, previous[:, c], lanes, out[:, m, b] if full else None)
                if bit.max() > limit:
                    raise BadMedia("a frame's data ends early")
            if full:
                out[live, m, b, 0] = previous[live, c]
            else:
                out[live, m, b] = previous[live, c]
    if len(bit) and bit.max() > limit + 95:
        raise BadMedia("a frame's data ends early")
    done, result = 0, []
    for n, k in zip(total.tolist(), parts.tolist(), strict=True):
        mine = out[done : done + k]
        flat = mine.reshape(k * most, *mine.shape[2:]) if k and int(count[done]) == most else np.concatenate([mine[i, : count[done + i]] for i in range(k)])
        result.append(flat[:n])
        done += k
    return result


def _slow_block(windows, dc, ac, bit, previous, lanes, out) -> None:
    """One block of each lane, symbol by symbol, in lock-step."""

    def symbol(at, table):
        word = windows[np.minimum(at >> 3, len(windows) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)
        entry = table[(word >> np.uint64(48)).astype(np.int64)]
        if (entry == 0).any():
            raise BadMedia("no such code")
        length, size = entry >> 8, entry & 15
        extra = ((word << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)
        return entry & 255, _value(extra.astype(np.int64), size), at + length + size

    _, value, bit[lanes] = symbol(bit[lanes], dc)
    previous[lanes] += value
    k = np.ones(len(lanes), np.int64)
    while len(lanes):
        code, value, bit[lanes] = symbol(bit[lanes], ac)
        run, size = code >> 4, code & 15
        k = k + np.where(size > 0, run, 16)
        coded = size > 0
        if (k[coded] > 63).any():
            raise BadMedia("too many coefficients")
        if out is not None:
            out[lanes[coded], k[coded]] = value[coded]
        k = k + coded
        stay = ~((size == 0) & (run < 15)) & (k <= 63)
        lanes, k = lanes[stay], k[stay]


def _grouped(frames: list[bytes]) -> list[tuple[list[int], list[Layout], list[bytes]]]:
    groups: dict = {}
    for i, f in enumerate(frames):
        a = scan_start(f)
        x = layout(f[:a])
        groups.setdefault(x.tables, ([], [], []))
        for part, y in zip(groups[x.tables], (i, x, f[a:]), strict=True):
            part.append(y)
    return [*groups.values()]


def dc_images(frames: list[bytes]) -> list[np.ndarray]:
    """The luminance at an eighth of its size: the mean of every 8x8 block, 0 to 255."""
    out: list = [None] * len(frames)
    for at, layouts, scans in _grouped(frames):
        for i, x, terms in zip(at, layouts, decode_scans(scans, layouts), strict=True):
            out[i] = np.clip((terms * x.quantisers[0][0] + 4 >> 3) + 128, 0, 255).astype(np.uint8) if len(x.sampling) == 1 else None
            rows, cols = x.mcus
            if len(x.sampling) == 1:
                out[i] = out[i].reshape(rows, cols)
            else:
                h, v = x.sampling[0]
                grey = np.clip((terms[:, : h * v].astype(np.int64) * x.quantisers[0][0] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
                out[i] = grey.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
    return out


def planes(frame: bytes) -> list[np.ndarray]:
    """Every component of a frame in full, cut to its own size."""
    (_, [x], scans) = _grouped([frame])[0]
    [coefficients] = decode_scans(scans, [x], full=True)
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)
    rows, cols = x.mcus
    top, out, at = (max(s[0] for s in x.sampling), max(s[1] for s in x.sampling)), [], 0
    for c, (h, v) in enumerate(x.sampling):
        if len(x.sampling) == 1:
            h = v = 1
            top = (1, 1)
        block = np.zeros((len(coefficients), h * v, 64))
        block[..., ZIGZAG] = coefficients[:, at : at + h * v] * np.array(x.quantisers[c])
        pixels = np.einsum("ij,mbjk,lk->mbil", basis, block.reshape(-1, h * v, 8, 8), basis) + 128
        image = pixels.reshape(rows, cols, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, cols * h * 8)
        out.append(np.clip(np.rint(image), 0, 255).astype(np.uint8)[: -(-x.height * v // top[1]), : -(-x.width * h // top[0])])
        at += h * v
    return out


# --- Storing bytes as frames ---


def _header(width: int, height: int) -> bytes:
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8" + part(0xDB, b"\0" + bytes([8]) + bytes([16]) * 63) + part(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + part(0xC4, b"\x00" + bytes(DC_BITS[0]) + bytes(range(12))) + part(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
        + part(0xDD, struct.pack(">H", UNIT)) + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a block whose DC term differs by -255 .. 255 from the last."""
    code, n, table = 0, 0, {}
    for length in range(1, 17):
        for _ in range(DC_BITS[0][length - 1]):
            table[n], code, n = (code, length), code + 1, n + 1
        code <<= 1
    word, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        c, length = table[k]
        word[d + 255], size[d + 255] = (c << k | (d if d >= 0 else d + (1 << k) - 1)) << 1, length + k + 1
    return word, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length must be a positive multiple of 64."""
    shapes = []
    for p in payloads:
        rows = len(p) // UNIT
        n = -(-rows // FRAME_ROWS)
        shapes.append((n, -(-rows // n)))
    filled = b"".join(p + bytes(n * h * UNIT - len(p)) for p, (n, h) in zip(payloads, shapes, strict=True))
    samples = np.frombuffer(filled, np.uint8).reshape(-1, UNIT).astype(np.int64)
    word, size = _codes()
    step = np.diff(samples, axis=1, prepend=128) + 255
    code, bits = word[step], size[step]
    upto = np.cumsum(bits, axis=1)
    length = (upto[:, -1] + 7) // 8
    begin = np.cumsum(length) - length
    at = (begin[:, None] * 8 + upto - bits).ravel()
    spread = code.ravel() << (24 - bits.ravel() - (at & 7))
    cell, total = at >> 3, int(length.sum())
    packed = sum(np.bincount(cell + k, spread >> (16 - 8 * k) & 255, total + 2) for k in range(3)).astype(np.int64)[:total]
    packed[begin + length - 1] += (1 << (length * 8 - upto[:, -1])) - 1
    # Stuffing after 0xFF, and a restart marker after every row but a frame's last.
    row_in_frame = np.concatenate([np.tile(np.arange(h), n) for n, h in shapes])
    last = np.concatenate([np.tile(np.arange(h) == h - 1, n) for n, h in shapes])
    full = packed == 255
    row = np.repeat(np.arange(len(length)), length)
    marks = np.concatenate(([0], np.cumsum(np.where(last, 0, 2))))
    to = np.arange(total) + np.cumsum(full) - full + marks[row]
    out = np.zeros(total + int(full.sum()) + int(marks[-1]), np.uint8)
    out[to] = packed
    ends = to[begin + length - 1] + 1 + full[begin + length - 1]
    out[ends[~last]] = 0xFF
    out[ends[~last] + 1] = 0xD0 + row_in_frame[~last] % 8
    data, cuts = out.tobytes(), [0, *ends[last].tolist()]
    files, k = [], 0
    for p, (n, h) in zip(payloads, shapes, strict=True):
        head = _header(8 * UNIT, 8 * h)
        files.append(write_avi([head + data[cuts[i] : cuts[i + 1]] + b"\xff\xd9" for i in range(k, k + n)], 8 * UNIT, 8 * h, b"payload %d" % len(p)))
        k += n
    return files


def payload(avi: Avi, images: list[np.ndarray]) -> bytes:
    """The bytes that `encode` stored."""
    data = b"".join(x.tobytes() for x in images)
    return data[: int(avi.comment.split()[1])] if avi.comment.startswith(b"payload ") else data


# --- Shots ---


def differences(images: list[np.ndarray]) -> np.ndarray:
    """Half the L1 distance of consecutive frames' histograms, 0 to 1; the first is 0."""
    h = np.array([np.bincount(x.ravel() >> 3, minlength=BINS) / max(1, x.size) for x in images])
    return np.concatenate(([0.0], np.abs(np.diff(h, axis=0)).sum(1) / 2)) if len(images) else np.empty(0)


def cuts(d: np.ndarray) -> list[int]:
    """Frames that begin a shot: a local peak well above the mean and spread of the differences around it."""
    found = []
    for t in range(1, len(d)):
        near = np.concatenate((d[max(1, t - WINDOW) : t], d[t + 1 : t + 1 + WINDOW]))
        high = near.mean() + SIGMAS * near.std() if len(near) else 0.5
        if d[t] >= FLOOR and d[t] > high and d[t] == d[max(1, t - 1) : t + 2].max():
            found.append(t)
    return found


def shots(avi: Avi, images: list[np.ndarray]) -> list[tuple[int, int, float, float, float]]:
    """Of each shot the first frame, the one after its last, both as seconds, and the difference at its start."""
    d = differences(images)
    edges = [0, *cuts(d), len(images)]
    return [(s, e, s / avi.fps, e / avi.fps, float(d[s])) for s, e in zip(edges, edges[1:], strict=False) if e > s]


def _read(files: list[bytes | None]) -> list[tuple[Avi | None, list[np.ndarray], str | None]]:
    """Of each file its header, DC images, and what is wrong with it."""
    parsed: list = []
    for f in files:
        try:
            avi = parse_avi(f)
            frames = [f[o : o + n] for o, n in avi.frames]
            _grouped(frames)
            parsed.append((avi, frames, None))
        except (ValueError, IndexError, struct.error) as e:
            parsed.append((None, [], str(e) or type(e).__name__))
    try:
        images = iter(dc_images([x for _, frames, _ in parsed for x in frames]))
        return [(avi, [next(images) for _ in frames], bad) for avi, frames, bad in parsed]
    except (ValueError, IndexError):  # one bad frame: find it file by file
        out = []
        for avi, frames, bad in parsed:
            try:
                out.append((avi, dc_images(frames), bad))
            except (ValueError, IndexError) as e:
                out.append((None, [], str(e) or type(e).__name__))
        return out


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each shot: key, clip, start_frame, end_frame (exclusive), start_s, end_s, difference at its start, problem."""
    ship(media.sparkSession)

    def go(batches):
        for batch in batches:
            for a, b in slices([n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()], 1 << 22):
                keys, files, out = batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), []
                held = [i for i, f in enumerate(files) if f is not None]
                for i, (avi, images, bad) in zip(held, _read([files[i] for i in held]), strict=True):
                    if bad:
                        out.append((keys[i], None, None, None, None, None, None, bad))
                        continue
                    found = shots(avi, images)
                    out += [(keys[i], k, *x, avi.problem) for k, x in enumerate(found)]
                    if avi.problem and not found:
                        out.append((keys[i], None, None, None, None, None, None, avi.problem))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(8)], names=["k", "clip", "start_frame", "end_frame", "start_s", "end_s", "difference", "problem"])

    kind = media.schema[key].dataType.simpleString()
    rows = media.select(F.col(key), F.col(column).cast("binary"))
    return rows.mapInArrow(lean(go), f"k {kind}, clip int, start_frame long, end_frame long, start_s double, end_s double, difference double, problem string").withColumnRenamed("k", key)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's bytes as an AVI file in `media`."""
    ship(docs.sparkSession)

    def go(batches):
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 1 << 21):
                part = batch.slice(a, b - a)
                files = encode([t + bytes(-len(t) % UNIT if t else UNIT) for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(go), "doc_id long, n_bytes long, media binary")


CLIPS = pa.list_(pa.struct([("start_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def digests(stored: DataFrame) -> DataFrame:
    """What is read back of each stored file: its payload's length and digests, the file's own, its shots as a feature, and as timed clips."""
    ship(stored.sparkSession)

    def feature(images, found):
        later = found[1:]
        return f"{len(images)}x{images[0].shape[0]}x{images[0].shape[1]};cuts={','.join(str(x[0]) for x in later)};diff={','.join(str(round(1000 * x[4])) for x in later)};mean={sum(int(x.sum()) for x in images) // max(1, sum(x.size for x in images))}"

    def go(batches):
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 1 << 22):
                part, out = batch.slice(a, b - a), []
                files = part.column(2).to_pylist()
                for f, (avi, images, bad) in zip(files, _read(files), strict=True):
                    if bad or avi.problem:
                        raise BadMedia(bad or avi.problem)
                    p, found = payload(avi, images), shots(avi, images)
                    clip_rows = [dict(zip(("start_frame", "end_frame", "start_s", "end_s"), x, strict=False)) for x in found]
                    out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature(images, found), clip_rows))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in out], kinds[k]) for k in range(7))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(go), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_frame: long, end_frame: long, start_s: double, end_s: double>>")
