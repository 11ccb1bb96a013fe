import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from weirlog.llm import media

from cases import documents, empty


def test_payloads_come_back():
    rng = random.Random(1)
    payloads = [bytes(64), b"\xff" * 128, bytes(range(256))] + [rng.randbytes(64 * rng.choice([1, 2, 15, 16, 17, 33, 100])) for _ in range(40)]
    for p, (avi, images, bad) in zip(payloads, media._read(media.encode(payloads)), strict=True):
        assert bad is None and media.payload(avi, images) == p


def bits_of(table):
    """Code and length of each symbol of a Huffman table."""
    bits, symbols = table
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def jpeg(blocks, width, height, sampling, quantiser, restart=0):
    """A baseline frame with the standard tables; blocks[mcu] lists (component, 64 coefficients in coded order)."""
    tables = {(k, c): bits_of((bytes(d[c]), bytes(range(12)) if k == 0 else media._ac_symbols(c))) for k, d in ((0, media.DC_BITS), (1, media.AC_BITS)) for c in (0, 1)}
    data, word, last = bytearray(), "", [0] * len(sampling)

    def put(code, length):
        nonlocal word
        word += format(code, f"0{length}b") if length else ""

    def flush():
        nonlocal word
        word += "1" * (-len(word) % 8)
        for i in range(0, len(word), 8):
            b = int(word[i : i + 8], 2)
            data.append(b)
            if b == 255:
                data.append(0)
        word = ""

    def number(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    for m, mcu in enumerate(blocks):
        if restart and m and m % restart == 0:
            flush()
            data.extend((0xFF, 0xD0 + (m // restart - 1) % 8))
            last = [0] * len(sampling)
        for c, z in mcu:
            t = min(c, 1)
            size, extra = number(z[0] - last[c])
            last[c] = z[0]
            put(*tables[0, t][size])
            put(extra, size)
            run = 0
            top = max((i for i in range(1, 64) if z[i]), default=0)
            for i in range(1, top + 1):
                if not z[i]:
                    run += 1
                    continue
                while run > 15:
                    put(*tables[1, t][0xF0])
                    run -= 16
                size, extra = number(z[i])
                put(*tables[1, t][run << 4 | size])
                put(extra, size)
                run = 0
            if top < 63:
                put(*tables[1, t][0])
    flush()
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    frame = b"".join(struct.pack("BBB", c + 1, h << 4 | v, 0) for c, (h, v) in enumerate(sampling))
    scan = b"".join(struct.pack("BB", c + 1, min(c, 1) * 0x11) for c in range(len(sampling)))
    head = b"\xff\xd8" + part(0xDB, b"\0" + bytes(quantiser)) + part(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + frame) + (part(0xDD, struct.pack(">H", restart)) if restart else b"")
    return head + part(0xDA, bytes([len(sampling)]) + scan + b"\0\x3f\0") + bytes(data) + b"\xff\xd9"


def pixels(z, quantiser):
    natural = np.zeros(64)
    natural[media.ZIGZAG] = np.array(z) * np.array(quantiser)
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    cu, cv = (np.sqrt(0.5) if k == 0 else 1 for k in (u, v))
                    out[y, x] += cu * cv / 4 * natural[v * 8 + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.rint(out + 128), 0, 255)


def block(rng):
    z = [rng.randrange(-60, 60)] + [0] * 63
    for _ in range(rng.randrange(9)):
        z[rng.randrange(1, 64)] = rng.randrange(-30, 31)
    return z


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_intra_frames_decode(restart):
    rng = random.Random(restart)
    quantiser = [2 + i % 5 for i in range(64)]
    grey = [[(0, block(rng))] for _ in range(6)]
    [plane] = media.planes(jpeg(grey, 24, 16, [(1, 1)], quantiser, restart))
    for m, [(_, z)] in enumerate(grey):
        y, x = divmod(m, 3)
        assert abs(plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - pixels(z, quantiser)).max() <= 1
    colour = [[(c, block(rng)) for c in (0, 0, 0, 0, 1, 2)] for _ in range(2)]
    luma, cb, _ = media.planes(jpeg(colour, 32, 16, [(2, 2), (1, 1), (1, 1)], quantiser, restart))
    assert luma.shape == (16, 32) and cb.shape == (8, 16)
    assert abs(luma[8:16, 16:24].astype(float) - pixels(colour[1][2][1], quantiser)).max() <= 1
    [small] = media.dc_images([jpeg(colour, 32, 16, [(2, 2), (1, 1), (1, 1)], quantiser, restart)])
    assert small.shape == (2, 4) and small[1, 2] == np.clip((colour[1][2][1][0] * quantiser[0] + 4 >> 3) + 128, 0, 255)


def flat(value, width=64, height=32):
    return jpeg([[(0, [value - 128] + [0] * 63)] for _ in range(width * height // 64)], width, height, [(1, 1)], [8] * 64)


def test_shots():
    frames = [flat(30)] * 12 + [flat(200)] * 9 + [flat(90)] * 7
    d = media.differences(media.dc_images(frames))
    assert media.cuts(d) == [12, 21]
    assert media.cuts(media.differences(media.dc_images([flat(50 + i % 2) for i in range(30)]))) == []


def test_clips(spark):
    file = media.write_avi([flat(30)] * 10 + [flat(220)] * 15, 64, 32, b"two shots")
    bare = file[: file.index(b"idx1")]  # without an index the movie list itself is read
    bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
    rows = [(1, file), (2, bare), (3, None), (4, b""), (5, b"RIFF\0\0\0\0AVI "), (6, file[:300]), (7, file.replace(b"\xff\xc0", b"\xff\xc2")), (8, media.write_avi([], 64, 32, b"")), (1, file)]
    frame = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)
    got = sorted((r["doc_id"], r["clip"], r["start_frame"], r["end_frame"], r["start_s"]) for r in media.clips(frame).collect() if r["problem"] is None)
    assert got == sorted([(i, 0, 0, 10, 0.0) for i in (1, 1, 2)] + [(i, 1, 10, 25, 0.4) for i in (1, 1, 2)])
    assert sorted(r["doc_id"] for r in media.clips(frame).collect() if r["problem"] is not None) == [4, 5, 6, 7]


def test_digests(spark):
    docs = documents(spark)
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    got = media.digests(media.store(docs)).collect()
    want = []
    for d, t in texts:
        p = t + bytes(-len(t) % 64 if t else 64)
        want.append((str(d), len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.digests(media.store(empty(spark))).count() == 0


def _chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _frames(n):
    """Frames of a stored file, and its header list."""
    data = media.encode([bytes(range(256)) * 4 * n])[0]
    avi = media.parse_avi(data)
    at = data.index(b"hdrl") - 8
    return [data[o : o + k] for o, k in avi.frames], data[at : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]


def _file(head, movies, after=b""):
    """A RIFF part for each movie list; `after` follows the first list."""
    parts = []
    for i, body in enumerate(movies):
        whole = (b"AVIX" if i else b"AVI " + head) + _chunk(b"LIST", b"movi" + body) + (b"" if i else after)
        parts.append(b"RIFF" + struct.pack("<I", len(whole)) + whole)
    return b"".join(parts)


def _old_index(frames):
    out, at = [], 4
    for f in frames:
        out.append(struct.pack("<4sIII", b"00dc", 16, at, len(f)))
        at += len(_chunk(b"00dc", f))
    return _chunk(b"idx1", b"".join(out))


def test_two_parts():
    """The old index knows the first part alone."""
    frames, head = _frames(6)
    assert len(frames) == 6
    body = lambda fs: b"".join(_chunk(b"00dc", f) for f in fs)
    for after in (_old_index(frames[:3]), b""):
        data = _file(head, [body(frames[:3]), body(frames[3:])], after)
        avi = media.parse_avi(data)
        assert [data[o : o + n] for o, n in avi.frames] == frames and avi.problem is None


def test_record_lists_and_empty_frames():
    frames, head = _frames(4)
    lists = b"".join(_chunk(b"LIST", b"rec " + _chunk(b"01wb", b"sound") + _chunk(b"00dc", f)) for f in frames[:3])
    data = _file(head, [lists + _chunk(b"00dc", b"")])
    avi = media.parse_avi(data)
    assert [data[o : o + n] for o, n in avi.frames] == [*frames[:3], frames[2]] and avi.problem is None
    assert "4 frames, 3 were found" in media.parse_avi(_file(head, [lists])).problem


def test_index_of_indexes():
    """Each part has an index of its own; the stream's header lists them."""
    frames, _ = _frames(6)
    strh = b"vidsMJPG" + bytes(48)
    avih, dmlh = _chunk(b"avih", struct.pack("<14I", 40000, 0, 0, 0, 3, 0, 1, 0, 512, 128, 0, 0, 0, 0)), _chunk(b"dmlh", struct.pack("<I", 6))

    def build(places):
        indx = struct.pack("<HBBI4s12x", 4, 0, 0, 2, b"00dc") + b"".join(struct.pack("<QII", at, size, 3) for at, size in places)
        strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", bytes(40)) + _chunk(b"indx", indx)
        head = _chunk(b"LIST", b"hdrl" + avih + _chunk(b"LIST", strl) + _chunk(b"LIST", b"odml" + dmlh))
        movies, found, at = [], [], 0
        for i, part in enumerate((frames[:3], frames[3:])):
            base = at + 12 + (0 if i else len(head)) + 12
            offsets, body = [], b""
            for f in part:
                offsets.append((len(body) + 8, len(f)))
                body += _chunk(b"00dc", f)
            ix = _chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, 3, b"00dc", base, 0) + b"".join(struct.pack("<II", o, n) for o, n in offsets))
            found.append((base + len(body), len(ix)))
            movies.append(body + ix)
            at = len(_file(head, movies))
        return _file(head, movies), found

    _, places = build([(0, 0)] * 2)
    data, _ = build(places)
    avi = media.parse_avi(data)
    assert [data[o : o + n] for o, n in avi.frames] == frames and avi.problem is None
    assert media.payload(avi, media.dc_images(frames))[: 256 * 4] == bytes(range(256)) * 4


def test_header_that_counts_other_frames(spark):
    frames, head = _frames(3)
    data = _file(head, [_chunk(b"00dc", frames[0])])
    [row] = media.clips(spark.createDataFrame([(1, data)], "doc_id long, media binary")).collect()
    assert (row["start_frame"], row["end_frame"]) == (0, 1) and "3 frames, 1 were found" in row["problem"]
