"""MPEG audio streams: frame headers, checksums, tags and tables of variable bit rate, and bytes carried in frames.

A stream is a run of frames, each with a 4-byte header that gives its length. `scan` walks from frame to frame; where no
header follows it searches for one whose own successor agrees with it (or with which the stream ends), and counts what it
skipped. Tags stand before and after the frames. Frames of free format have no length in their header and count as junk.

`write` carries any bytes in silent frames of MPEG-1 layer III: a frame whose granules have no bits plays as silence, and
what follows its side information is ancillary data. The first frame holds the Xing table, as streams of variable bit rate
have it, and a tag says how many bytes there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Fixed values of the format: kbit/s by index from 1 to 14 for MPEG-1 layers I, II, III and for MPEG-2 layers I and II/III;
# samples a second by index for MPEG-1, halved for MPEG-2 and quartered for MPEG-2.5.
RATES_1 = {
    1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = (44100, 48000, 32000)
#: Layer II: bits of allocation by subband, as (bits, subbands) in order, by table.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19))}
#: What `write` uses: MPEG-1 layer III with checksum, 32 kHz (so frames of every bit rate have whole bytes), one channel.
_SAMPLES, _RATE, _SIDE = 1152, 32000, 17
_NAME = "payload_bytes"


class Header(NamedTuple):
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mode: int
    extension: int
    samples: int
    size: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)

    def agrees(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=65536)
def header(b: bytes) -> Header | None:
    """Four bytes as a header, None if they are none."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version = (25, None, 2, 1)[b[1] >> 3 & 3]
    layer = (None, 3, 2, 1)[b[1] >> 1 & 3]
    bit, rate = b[2] >> 4, b[2] >> 2 & 3
    if version is None or layer is None or bit in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    kbit = (RATES_1[layer] if version == 1 else RATES_2[min(layer, 2)])[bit - 1]
    hertz = SAMPLE_RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    pad = b[2] >> 1 & 1
    # a slot is four bytes in layer I, else one
    size = (12 * kbit * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + pad
    return Header(version, layer, not b[1] & 1, kbit * 1000, hertz, b[3] >> 6, b[3] >> 4 & 3, samples, size)


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _table()


@lru_cache(maxsize=4096)
def checksum(data: bytes, bits: int = 0, tail: int = 0) -> int:
    """CRC-16 (8005, from FFFF) of bytes, and of the upper `bits` bits of the byte `tail` after them."""
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    for i in range(bits):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (tail >> 7 - i & 1) else 0)
    return c


def _layer2_bits(h: Header, body: bytes) -> int:
    """Bits of allocation and of the selection of scale factors that the checksum covers."""
    each = h.bitrate // 1000 // h.channels
    name = "lsf" if h.version != 1 else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    bound = (h.extension + 1) * 4 if h.mode == 1 else 32
    value, n, at, used, band = int.from_bytes(body[:64], "big"), len(body[:64]) * 8, 0, 0, 0
    for bits, bands in ALLOCATION[name]:
        for _ in range(bands):
            for _ in range(h.channels if band < bound else 1):
                if at + bits > n:
                    return 0
                given = value >> n - at - bits & (1 << bits) - 1
                # above the bound one allocation stands for both channels
                used += (given != 0) * (1 if band < bound else h.channels)
                at += bits
            band += 1
    return at + 2 * used


def verified(h: Header, frame: bytes) -> bool | None:
    """Whether a frame's checksum is right; None if it has none."""
    if not h.protected:
        return None
    said, body = int.from_bytes(frame[4:6], "big"), frame[6:]
    if h.layer == 3:
        return len(body) >= h.side and checksum(frame[2:4] + body[: h.side]) == said
    if h.layer == 1:
        bound = (h.extension + 1) * 4 if h.mode == 1 else 32
        n = 16 if h.channels == 1 else (bound * 8 + (32 - bound) * 4) // 8
        return len(body) >= n and checksum(frame[2:4] + body[:n]) == said
    bits = _layer2_bits(h, body)
    whole, rest = divmod(bits, 8)
    return 0 < bits <= len(body) * 8 and checksum(frame[2:4] + body[:whole], rest, body[whole] if rest else 0) == said


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _said(b: bytes) -> str:
    """A text with its encoding before it."""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[b[0]] if b and b[0] < 4 else "latin-1"
    return b[1:].decode(kind, "replace").replace("\ufeff", "").strip("\0")


def _head_tag(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The end of an ID3v2 tag at `at` and its texts."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127 or data[at + 3] == 0xFF:
        return at, {}
    version, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size + (10 if flags & 0x10 else 0))
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:
        body = body[_syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
    name, head = (3, 6) if version == 2 else (4, 10)
    out: dict[str, str] = {}
    while len(body) > head and body[0]:
        raw = body[name : name + (3 if version == 2 else 4)]
        n = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        key, value, body = body[:name].decode("latin-1"), body[head : head + n], body[head + n :]
        if key.startswith("T"):
            text = _said(value)
            if key in ("TXXX", "TXX"):
                key, _, text = text.partition("\0")
            out.setdefault(key, text)
    return end, out


def _tail_tags(data: bytes, least: int) -> tuple[int, dict[str, str]]:
    """Where the tags at the end begin, and their texts."""
    end, out = len(data), {}
    if end - least >= 128 and data[end - 128 : end - 125] == b"TAG":
        t, end = data[end - 128 : end], end - 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if text := t[a:b].split(b"\0")[0].decode("latin-1").strip():
                out[key] = text
    if end - least >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, n, flags = (int.from_bytes(data[end - k : end - k + 4], "little") for k in (20, 16, 12))
        at = max(least, end - size)
        items, start = data[at : end - 32], max(least, at - (32 if flags >> 31 else 0))
        for _ in range(n):
            if len(items) < 9:
                break
            length, kind = int.from_bytes(items[:4], "little"), int.from_bytes(items[4:8], "little")
            key, _, rest = items[8:].partition(b"\0")
            if kind >> 1 & 3 == 0:
                out.setdefault(key.decode("latin-1"), rest[:length].decode("utf-8", "replace"))
            items = rest[length:]
        end = start
    return end, out


def _table_of(h: Header, frame: bytes) -> dict | None:
    """The table of variable bit rate in a stream's first frame: Xing (or Info) or VBRI."""
    if h.layer != 3:
        return None
    for at in (4 + h.side, 6 + h.side):
        if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "places", 100), (8, "quality", 4)):
                if flags & bit:
                    raw, at = frame[at : at + n], at + n
                    out[name] = list(raw) if n == 100 else int.from_bytes(raw, "big")
            more = frame[at : at + 24]
            if more[:4] in (b"LAME", b"Lavc", b"Lavf") and len(more) == 24:
                out["delay"], out["padding"] = more[21] << 4 | more[22] >> 4, (more[22] & 15) << 8 | more[23]
            return out
    if frame[36:40] == b"VBRI":
        size, frames, n, scale, width, each = (int.from_bytes(frame[a:b], "big") for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60), (60, 62)))
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "frames_a_place": each, "places": [sum(steps[:i]) for i in range(n)]}
    return None


class Stream(NamedTuple):
    """What a stream holds. The frame of a table is no sound and none of `offsets`; a cut last frame counts as skipped."""

    first: Header | None
    offsets: np.ndarray
    sizes: np.ndarray
    samples: int
    duration: Fraction
    right: int
    wrong: int
    skipped: int
    resyncs: int
    tags: dict
    table: dict | None


def _chained(data: bytes, at: int, end: int, h: Header) -> bool:
    """Whether an agreeing header follows the frame, or the stream ends with it."""
    after = header(data[at + h.size : at + h.size + 4])
    return at + h.size == end or (after is not None and after.agrees(h))


def _starts(data: bytes, at: int, end: int, h: Header) -> Iterator[bool]:
    """For each place within the frame that might begin one: whether it does."""
    to = data.find(b"\xff", at + 1, at + h.size)
    while to >= 0:
        x = header(data[to : to + 4])
        yield x is not None and x.agrees(h) and to + x.size <= end and _chained(data, to, end, x)
        to = data.find(b"\xff", to + 1, at + h.size)


def scan(data: bytes) -> Stream:
    at, tags = _head_tag(data, 0)
    end, more = _tail_tags(data, at)
    tags = {**more, **tags}
    first = table = last = None
    offsets, sizes = [], []
    rates: dict[int, int] = {}
    right = wrong = skipped = resyncs = 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= end
        if fits and last is not None:
            # in step; where junk follows, this may be junk already, with the next frames beginning within it
            fits = h.agrees(last) and (_chained(data, at, end, h) or not any(_starts(data, at, end, h)))
        elif fits:
            fits = _chained(data, at, end, h)
        if not fits:
            resyncs += last is not None
            last = None
            to = data.find(b"\xff", at + 1, end)
            to = to if to >= 0 else end
            skipped += to - at
            at = to
            continue
        frame = data[at : at + h.size]
        if (ok := verified(h, frame)) is not None:
            right, wrong = right + ok, wrong + (not ok)
        last, is_first = h, first is None
        if is_first:
            first, table = h, _table_of(h, frame)
        if not is_first or table is None:
            offsets.append(at)
            sizes.append(h.size)
            rates[h.rate] = rates.get(h.rate, 0) + h.samples
        at += h.size
    skipped += end - at
    spare = (table or {}).get("delay", 0) + (table or {}).get("padding", 0)
    duration = sum((Fraction(n, r) for r, n in rates.items()), Fraction(0))
    if first is not None and 0 < spare < rates.get(first.rate, 0):
        duration -= Fraction(spare, first.rate)
    return Stream(first, np.array(offsets, np.int64), np.array(sizes, np.int64), sum(rates.values()), duration, right, wrong, skipped, resyncs, tags, table)


def seek(stream: Stream, second: float) -> int | None:
    """The place of the frame that sounds at a time; None before the first and after the last."""
    if stream.first is None or second < 0:
        return None
    n = int(second * stream.first.rate // stream.first.samples)
    return int(stream.offsets[n]) if n < len(stream.offsets) else None


def describe(stream: Stream) -> str:
    """Format, exact duration in seconds, checksums, table and seek points as one line; equal streams give equal lines."""
    h = stream.first
    if h is None:
        return f"no audio; skipped={stream.skipped}"
    kbit = int(stream.sizes.sum()) * 8 * h.rate // max(stream.samples, 1)
    places = ",".join(map(str, stream.offsets[:: max(1, -(-len(stream.offsets) // 8))].tolist()))
    return f"mpeg{h.version} layer{h.layer} {h.rate}Hz {h.channels}ch; frames={len(stream.offsets)}; seconds={stream.duration}; bits a second={kbit}; checksums={stream.right}/{stream.right + stream.wrong}; table={(stream.table or {}).get('kind', 'none')}; skipped={stream.skipped}; seek={places}"


@lru_cache(maxsize=16)
def _silent(bit: int) -> bytes:
    """Header, checksum and side information of a silent frame of a bit rate's index."""
    head = bytes([0xFF, 0xFA, bit << 4 | 2 << 2, 0xC0])
    side = bytes(_SIDE)
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side


def _room(bit: int) -> int:
    return _SAMPLES // 8 * RATES_1[3][bit - 1] * 1000 // _RATE - len(_silent(bit))


def write(payload: bytes) -> bytes:
    """A stream of silent frames that carries `payload`: a tag with its length, a Xing table, frames as large as needed."""
    top = _room(14)
    parts = []
    for at in range(0, len(payload), top):
        piece = payload[at : at + top]
        bit = 14 if len(piece) == top else next(b for b in range(1, 15) if _room(b) >= len(piece))
        parts.append(_silent(bit) + piece + bytes(_room(bit) - len(piece)))
    # an empty frame ends the stream, so that no payload stands where readers look for tags
    parts.append(_silent(1) + bytes(_room(1)))
    body = b"\x00" + _NAME.encode() + b"\x00" + str(len(payload)).encode()
    tag = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    size = len(tag)
    tag = b"ID3\x03\x00\x00" + bytes(size >> k & 127 for k in (21, 14, 7, 0)) + tag
    # the table's frame is of 64 kbit/s, the smallest that holds its hundred places; places are shares of 256 of the bytes
    head = _silent(5)
    ends = np.cumsum([0, len(head) + _room(5), *map(len, parts)])
    total, n = int(ends[-1]), len(parts)
    places = bytes(min(255, int(ends[1 + i * n // 100]) * 256 // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + places
    return b"".join([tag, head, xing, bytes(_room(5) - len(xing)), *parts])


def carried(data: bytes, stream: Stream) -> bytes:
    """The bytes that silent frames carry behind their side information, as many as the tag says."""
    h = stream.first
    if h is None:
        return b""
    parts = []
    for at, size in zip(stream.offsets.tolist(), stream.sizes.tolist()):
        h = header(data[at : at + 4])
        if h.layer == 3:
            start = at + 4 + 2 * h.protected
            if not any(data[start : start + h.side]):
                parts.append(data[start + h.side : at + size])
    out = b"".join(parts)
    said = stream.tags.get(_NAME, "")
    return out[: int(said)] if said.isdecimal() else out
