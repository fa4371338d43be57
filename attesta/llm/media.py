"""Media columns: payloads kept as baseline JPEG, thumbnails rebuilt from the DC terms of its scans.

Storing. Each byte of a payload is the DC term of one 8x8 luminance block (DC step 8, so the DC-only pixel of a
block is the byte itself: the form is lossless at the scale of blocks). Rows are 64 blocks wide. DC differences take
the standard's luminance code, of 2 to 9 bits and as many bits as the difference has, and each block ends with an
end-of-block code: any baseline decoder reads the file. An image holds up to 8,191 rows of blocks; longer payloads
continue in further images of the same stream.

Reading. ``decode_dc`` parses the markers, undoes byte stuffing, Huffman-decodes the scans and integrates the DC
differences, all by array operations. Codes have any width, so where a block begins depends on all before it. The
decoder looks a code up at *every* bit of the scan (16 bits ahead), which says for each bit where a block that began
there would end; the end of a group of blocks is the composition of these, groups are found by jumps of ``STRIDE``,
and the places between by halving. The same path reads AC terms, several components, subsampling, restart intervals,
and components in scans of their own.

Edge cases: a null or empty text is a payload of 64 zero bytes; a null id is kept; texts of any length are taken whole
(an Arrow batch holds few rows); repeated rows give repeated results; null, empty or damaged media give null features
and say why in ``error``; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, map_batches, short_batches, table

BLOCKS = 64  #: blocks in a row
MAX_ROWS = 65535 // 8  #: rows of blocks that an image height can state
STRIDE = 16  #: groups of blocks that one jump skips

# Fixed values of the JPEG standard: markers, and the code lengths of its luminance DC table (categories 0 to 11).
SOI, EOI, SOF0, DHT, DQT, DRI, SOS = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: AC table of the files made here: nothing but the end of a block.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], length, code))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Lookup:
    """A Huffman table by the 16 bits that follow: symbol, and code length (0 where no code fits)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for s, length, code in canonical(counts, symbols):
            at = slice(code << 16 - length, code + 1 << 16 - length)
            self.symbol[at], self.size[at] = s, length
        #: as a DC table: bits of the code and the difference; as an AC table: bits of an end-of-block code, else 0
        self.through = np.where(self.size > 0, self.size.astype(np.int64) + self.symbol, 1 << 40)
        self.last = np.where((self.size > 0) & (self.symbol == 0), self.size, 0).astype(np.int64)
        self.others = bool(((self.size > 0) & (self.symbol != 0)).any())


_lookup = lru_cache(64)(Lookup)  # files of one maker share their tables


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of each difference from -255 to 255 with the end of its block."""
    table_ = {s: (length, code) for s, length, code in canonical(DC_COUNTS, DC_SYMBOLS)}
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        length, code = table_[c]
        extra = diff if diff >= 0 else diff + (1 << c) - 1
        bits[diff + 255], sizes[diff + 255] = (code << c | extra) << 1, length + c + 1
    return bits, sizes


BITS, SIZES = _codes()
_HEAD_A = (
    b"\xff\xd8"
    + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    + _segment(DQT, bytes([0, 8] + [1] * 63))
)
_HEAD_B = (
    _segment(DHT, b"\x00" + DC_COUNTS + DC_SYMBOLS)
    + _segment(DHT, b"\x10" + AC_COUNTS + AC_SYMBOLS)
    + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _entropy(part: np.ndarray) -> bytes:
    """The scan of a plane of DC terms, stuffed."""
    diff = np.empty_like(part)
    diff[0] = part[0] - 128
    np.subtract(part[1:], part[:-1], out=diff[1:])
    diff += 255
    size = SIZES[diff]
    end = np.cumsum(size)
    start, total = end - size, int(end[-1])
    # a code of up to 18 bits lies within four bytes; no two codes share a bit, so their sum is their union
    word = BITS[diff] << (32 - size - (start & 7)).astype(np.uint32)
    first = start >> 3
    out = np.zeros((total + 7 >> 3) + 4, np.int64)
    for k in range(4):
        part_of = word >> np.uint32(24 - 8 * k) & np.uint32(0xFF)
        out[k:] += np.bincount(first, part_of, len(out) - k).astype(np.int64)
    n = total + 7 >> 3
    if total & 7:
        out[n - 1] |= (1 << 8 - (total & 7)) - 1  # ones fill the last byte
    return out[:n].astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    """JPEG stream of a payload whose length is a positive multiple of 64."""
    if not payload or len(payload) % BLOCKS:
        raise ValueError("a payload is a positive multiple of 64 bytes long")
    out = []
    for at in range(0, len(payload), BLOCKS * MAX_ROWS):
        part = np.frombuffer(payload, np.uint8, min(len(payload) - at, BLOCKS * MAX_ROWS), at).astype(np.int16)
        height = len(part) // BLOCKS * 8
        frame = _segment(SOF0, bytes([8]) + height.to_bytes(2, "big") + (BLOCKS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        out += [_HEAD_A, frame, _HEAD_B, _entropy(part), b"\xff\xd9"]
    return b"".join(out)


def _ends(ahead: np.ndarray, dc: Lookup, ac: Lookup) -> np.ndarray:
    """For each bit, the bit behind a block that begins there; one more than there are bits where none does."""
    n = len(ahead) - 1
    to = np.arange(n + 1)
    to += dc.through.take(ahead)  # behind the code and the bits of the difference; beyond all where no code fits
    np.minimum(to, n, out=to)
    code = ahead.take(to)
    ends = to + ac.last.take(code)  # most blocks end at once
    open_ = np.flatnonzero((ac.last.take(code) == 0) & (to < n) & (ac.size.take(code) > 0)) if ac.others else ends[:0]
    ends[(ends > n) | (ac.last.take(code) == 0)] = n + 1
    ends[n] = n + 1
    start, at, k = open_, to[open_], np.ones(len(open_), np.int64)
    while len(at):
        code = ahead[at]
        s, length = ac.symbol[code], ac.size[code].astype(np.int64)
        run, more = s >> 4, s & 15
        to = at + length + more
        over = (more == 0) & (run != 15) | (k + run + 1 >= 64)  # the block's last code
        good = (length > 0) & (to <= n)
        done = over & good
        ends[start[done]] = to[done]
        left = good & ~over & (to < n)
        start, at, k = start[left], to[left], (k + run + 1)[left]
    return ends


def _chain(step: np.ndarray, count: int) -> np.ndarray:
    """Places 0, step[0], step[step[0]], ...: ``count`` of them."""
    jumps, k = [step], 1
    while k < STRIDE and k < count:
        jumps.append(jumps[-1].take(jumps[-1], mode="clip"))
        k *= 2
    far = memoryview(jumps[-1])
    places, at = [], 0
    for _ in range(-(-count // k)):
        places.append(at)
        at = far[min(at, len(far) - 1)]
    out = np.array(places, np.int64)
    for jump in reversed(jumps[:-1]):
        out = np.stack([out, jump.take(out, mode="clip")], 1).reshape(-1)
    return out[:count]


def _segment_dc(data: bytes, layout: list[dict], groups: int, wanted: int) -> np.ndarray:
    """DC terms of component ``wanted`` in one restart interval: a row for each group (MCU), a column for each of its blocks.

    ``layout`` has the tables of each block of a group in order.
    """
    raw = np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8).astype(np.uint32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    n = 8 * len(data)
    shift = np.arange(8, 0, -1, dtype=np.uint32)
    ahead = (three[: len(data) + 1, None] >> shift & np.uint32(0xFFFF)).astype(np.int64).reshape(-1)[: n + 1]
    ends: dict[tuple[int, int], np.ndarray] = {}
    for b in layout:
        if b["tables"] not in ends:
            ends[b["tables"]] = _ends(ahead, b["dc"], b["ac"])
    step = ends[layout[0]["tables"]]
    for b in layout[1:]:
        step = ends[b["tables"]].take(step, mode="clip")
    place = _chain(step, groups)
    diffs = []
    for b in layout:
        if (place >= n).any():
            raise ValueError("a scan ends early")
        if b["id"] == wanted:
            code = ahead[place]
            size, length = b["dc"].symbol[code].astype(np.int64), b["dc"].size[code]
            if (length == 0).any() or size.max() > 11:
                raise ValueError("a scan has a code that its table lacks")
            follow = ahead[np.minimum(place + length, n)] >> 16 - size
            diffs.append(np.where((size > 0) & (follow >> np.maximum(size - 1, 0) == 0), follow - (1 << size) + 1, follow))
        place = ends[b["tables"]][place]
    if (place > n).any():
        raise ValueError("a scan ends early")
    return np.cumsum(np.stack(diffs, 1).reshape(-1), dtype=np.int64).astype(np.int32).reshape(groups, -1)


def _scan_dc(scan: bytes, comps: list[dict], shape: tuple[int, int], full: tuple[int, int], interval: int, wanted: int) -> np.ndarray:
    """The plane of DC terms of component ``wanted`` in one scan; ``full`` is the frame's greatest sampling."""
    height, width = shape
    pieces, start, k = [], 0, 0
    while (k := scan.find(b"\xff", k)) >= 0:
        if k + 1 < len(scan) and 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[start:k])
            start = k + 2
        k += 2
    pieces.append(scan[start:])
    c = next(c for c in comps if c["id"] == wanted)
    single = len(comps) == 1
    if single:
        rows, cols, v, h = -(-(-(-height * c["v"] // full[0])) // 8), -(-(-(-width * c["h"] // full[1])) // 8), 1, 1
    else:
        rows, cols, v, h = -(-height // (8 * full[0])), -(-width // (8 * full[1])), c["v"], c["h"]
    layout = [x for x in comps for _ in range(1 if single else x["v"] * x["h"])]
    total, out = rows * cols, []
    for piece in pieces:
        count = min(interval or total, total - sum(map(len, out)))
        if count > 0:
            out.append(_segment_dc(piece.replace(b"\xff\x00", b"\xff"), layout, count, wanted))
    if sum(map(len, out)) != total:
        raise ValueError("a scan lacks restart intervals")
    dc = np.concatenate(out).reshape(rows, cols, v, h)
    return dc.transpose(0, 2, 1, 3).reshape(rows * v, cols * h)


def decode_dc(data: bytes) -> list[dict]:
    """For each image of a stream: width, height, and its luminance thumbnail, one pixel for each 8x8 block of it."""
    at, images = 0, []
    quant, huff, frame, interval = {}, {}, None, 0
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == SOI:
            quant, huff, frame, interval = {}, {}, None, 0
            continue
        if marker == EOI:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if at + size > len(data):
            raise ValueError("a segment ends early")
        body = data[at + 2 : at + size]
        at += size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = int.from_bytes(body[1 : 3 if wide else 2], "big")
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                counts = body[1:17]
                huff[body[0]] = _lookup(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == DRI:
            interval = int.from_bytes(body[:2], "big")
        elif marker == SOF0:
            frame = {"h": int.from_bytes(body[1:3], "big"), "w": int.from_bytes(body[3:5], "big"), "c": [
                {"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])
            ]}
            if not frame["h"] or not frame["w"] or not frame["c"]:
                raise ValueError("a frame without size")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == SOS:
            if frame is None:
                raise ValueError("a scan without a frame")
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            scan, at = data[at:end], end
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            comps = [c | {"tables": (used[c["id"]] >> 4, used[c["id"]] & 15), "dc": huff[used[c["id"]] >> 4], "ac": huff[0x10 | used[c["id"]] & 15]} for c in frame["c"] if c["id"] in used]
            y = frame["c"][0]  # luminance; scans of the others alone are passed over
            if y["id"] not in used:
                continue
            full = max(c["v"] for c in frame["c"]), max(c["h"] for c in frame["c"])
            rows, cols = -(-frame["h"] * y["v"] // (8 * full[0])), -(-frame["w"] * y["h"] // (8 * full[1]))
            dc = _scan_dc(scan, comps, (frame["h"], frame["w"]), full, interval, y["id"])[:rows, :cols]
            thumb = np.clip((dc * quant[y["q"]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            images.append({"width": frame["w"], "height": frame["h"], "thumb": thumb})
    return images


def thumb_hash(thumb: np.ndarray) -> str:
    """Average hash: 8x8 cell means of the thumbnail against their mean, as 16 hex digits."""
    cells = thumb.astype(np.int64)
    width = []
    for axis in (0, 1):
        n = thumb.shape[axis]
        low = np.arange(8) * n // 8
        cells = np.add.reduceat(cells, low, axis)  # where cells are fewer than 8, repeats stand for themselves
        width.append(np.maximum(np.diff(low, append=n), 1))
    cells = cells / width[0][:, None] / width[1]
    return np.packbits(cells.reshape(-1) > cells.mean()).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, padded with zero bytes, as a JPEG stream."""
    short_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for t in b.column(1).cast(pa.large_binary()):
            raw = t.as_py() or b""
            sizes.append(len(raw))
            media.append(encode_payload(raw + bytes(-len(raw) % BLOCKS if raw else BLOCKS)))
        return batch(**{id_col: b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return map_batches(docs.select(id_col, text_col), f, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def described(data: bytes | None) -> tuple:
    """Payload length, its digest, checksum of its tail, media length and digest, feature, and an error (else null)."""
    if not data:
        return None, None, None, None if data is None else 0, None, None, "no media"
    held = len(data), hashlib.sha256(data).hexdigest()
    try:
        images = decode_dc(data)
        if not images:
            raise ValueError("no image")
        thumb = images[0]["thumb"] if len(images) == 1 else np.concatenate([i["thumb"] for i in images])
    except (ValueError, IndexError, KeyError) as e:
        return None, None, None, *held, None, str(e) or type(e).__name__
    payload = thumb.tobytes()
    feature = f"{images[0]['width']}x{sum(i['height'] for i in images)}:{thumb_hash(thumb)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *held, feature, None


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads ``media`` back: payload and its digests, dimensions and thumbnail hash; null with an ``error`` if it can't."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [described(m.as_py()) for m in b.column("media")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
        cols = {n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows, strict=True), strict=True)}
        return batch(**{id_col: b.column(id_col), "n_bytes": b.column("n_bytes")}, **cols)

    kind = media.schema[id_col].dataType.simpleString()
    return map_batches(media.select(id_col, "n_bytes", "media"), f, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
