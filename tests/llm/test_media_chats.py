"""Hard negatives, MPEG streams and conversations against plain Python and by hand."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import pytest

from regolith.llm import chats, media, mpeg, negatives, queries

SF = "/root/testdata/sf0.001"


# Hard negatives.


def plain_negatives(rows):
    kept = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, int(math.fmod(y + 1, 10)) if i is not None and i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    first = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = []
    for i, y, v in kept:
        if i is None or i % 100:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), z) for j, z, w in kept if j != i]
        for pid, p, _ in sorted((s for s in scored if s[2] == y), key=first)[:5]:
            fits = sorted((s for s in scored if s[2] != y and 30 * p <= 100 * s[1] <= 90 * p), key=first)[:10]
            out += [(i, pid, n, j, p, s) for n, (j, s, _) in enumerate(fits, 1)]
    return out


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, q string")
    from pyspark.sql import functions as F

    label = F.col("label").cast("long")
    r = negatives.prepared(df, "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return [tuple(x) for x in negatives.mine(r, r.filter("id % 100 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_negatives(spark, monkeypatch):
    rng = random.Random(5)
    vec = lambda: [rng.choice((-0.5, 0.0, 0.26, 0.5, 0.75, 1.0)) for _ in range(4)]  # noqa: E731 (many ties)
    rows = [(i, vec(), rng.randrange(3)) for i in range(420)]
    rows += [(100, vec(), 1), (100, vec(), 1), (None, vec(), 0), (None, vec(), 1), (431, None, 1), (432, [float("nan"), 1.0, 1.0, 1.0], 1), (433, [1.0, None, 1.0, 1.0], 0), (434, vec(), None), (435, [float("inf")] * 4, 1), (436, [], 1), (437, [1.0, 1.0], 0), (700, vec(), 9), (800, [3e38] * 4, 2)]
    rows += [(500, [1.0] * 4, 1)] * 3 + [(501, [0.5, 0.5, 0.5, 0.5], 2)] * 40
    rows = [r for r in rows if r[0] != 800]  # beyond a long: see below
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain_negatives(rows), key=key)
    assert sorted(mined(spark, rows), key=key) == want and len(want) > 500
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert sorted(mined(spark, rows), key=key) == want
    assert mined(spark, rows[:0]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    mined(spark, [*rows, (800, [3e38] * 4, 2), (900, [-3e38, 1.0, 1.0, 1.0], 2)])


def test_limits():
    for p in range(-50, 50):
        least, most = negatives.limits(p, 30, 90)
        assert [n for n in range(-99, 99) if 30 * p <= 100 * n <= 90 * p] == list(range(least, most + 1))


# MPEG streams.


@pytest.mark.parametrize("n", [0, 1, 64, 1416, 1417, 1418, 70_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    for payload in (data, data[:-128] + b"TAG" + data[-125:] if n > 128 else b"TAG", data + b"APETAGEX" + bytes(24)):
        stream = mpeg.write(payload)
        s = mpeg.scan(stream)
        assert mpeg.carried(stream, s) == payload and s.skipped == s.wrong == 0 and s.right == len(s.offsets) + 1
        assert s.table["frames"] == len(s.offsets) and s.duration == Fraction(1152 * len(s.offsets), 32000)
        assert all(stream[o] == 0xFF for o in s.offsets) and len(stream) - int(s.offsets[0]) == s.sizes.sum()
        total = s.table["bytes"]  # places are shares of the bytes from the table's frame on
        begin = len(stream) - total
        for i in range(0, 100, 7):
            assert s.table["places"][i] == min(255, (int(s.offsets[i * len(s.offsets) // 100]) - begin) * 256 // total)


def slow_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ b
        c = c << 1 & 0xFFFF
        c ^= 0x8005 if top else 0
    return c


def frame(bit=9, rate=0, pad=0, mode=3, fill=0, crc=None, layer=3, version=3):
    """A frame by hand: MPEG-1 layer III at 128 kbit/s by default."""
    head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (crc is None), bit << 4 | rate << 2 | pad << 1, mode << 6])
    body = bytes([fill]) * (mpeg.header(head).size - 4 - (2 if crc is not None else 0))
    return head + (b"" if crc is None else crc.to_bytes(2, "big")) + body


def test_headers():
    # sizes as published: 417 and 418 bytes at 128 kbit/s and 44.1 kHz, 626 for layer II at 192, 32 kHz at 320
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0xC0])).size == 417 and mpeg.header(bytes([0xFF, 0xFB, 0x92, 0xC0])).size == 418
    h = mpeg.header(bytes([0xFF, 0xFD, 0xA0, 0x00]))
    assert (h.layer, h.bitrate, h.size, h.samples, h.channels) == (2, 192000, 626, 1152, 2)
    h = mpeg.header(bytes([0xFF, 0xF3, 0x80, 0xC0]))  # MPEG-2 layer III
    assert (h.version, h.rate, h.bitrate, h.samples, h.size) == (2, 22050, 64000, 576, 208)
    h = mpeg.header(bytes([0xFF, 0xE3, 0x10, 0xC0]))  # MPEG-2.5
    assert (h.version, h.rate, h.bitrate, h.size) == (25, 11025, 8000, 52)
    h = mpeg.header(bytes([0xFF, 0xFF, 0x1A, 0xC0]))  # layer I, slots of four bytes
    assert (h.layer, h.size, h.samples) == (1, 52, 384)
    assert [mpeg.header(bytes(b)) for b in ([0xFF, 0xFB, 0xF0, 0], [0xFF, 0xFB, 0x00, 0], [0xFF, 0xFB, 0x9C, 0], [0xFF, 0xEB, 0x90, 0], [0xFF, 0xF9, 0x90, 0], [0xFE, 0xFB, 0x90, 0], [0xFF, 0xFB])] == [None] * 7


def test_resynchronised():
    junk = b"\xff\xfb\x90\xc0" + b"noise" * 9 + b"\xff\xff\xff"
    data = junk + frame() * 3 + junk + frame(pad=1) * 2 + b"\xff\xfb\x90\xc0 cut"
    s = mpeg.scan(data)
    assert s.offsets.tolist() == [len(junk), len(junk) + 417, len(junk) + 834, 2 * len(junk) + 1251, 2 * len(junk) + 1251 + 418]
    assert s.skipped == 2 * len(junk) + 8 and s.samples == 5 * 1152 and s.duration == Fraction(5 * 1152, 44100)
    assert mpeg.seek(s, 0) == len(junk) and mpeg.seek(s, 1152 / 44100 * 3.5) == s.offsets[3] and mpeg.seek(s, 9) is None
    # another rate is not the same stream, and a single frame is one where it ends the data
    assert len(mpeg.scan(frame() + frame(rate=1)).offsets) == 1 and len(mpeg.scan(frame()).offsets) == 1 and len(mpeg.scan(frame() + b"x").offsets) == 0
    assert mpeg.scan(b"").first is None and mpeg.describe(mpeg.scan(b"abc")) == "no audio; skipped=3"


def test_checksums():
    bits = lambda b: [x >> 7 - i & 1 for x in b for i in range(8)]
    for layer, mode, bit, covered in ((3, 3, 9, 17 * 8), (3, 0, 9, 32 * 8), (1, 3, 9, 16 * 8), (1, 0, 9, 32 * 8), (2, 0, 10, 2 * (4 * 11 + 3 * 12 + 2 * 7)), (2, 3, 1, 4 * 2 + 3 * 6)):
        bare = frame(bit=bit, mode=mode, layer=layer, crc=0)
        right = slow_crc(bits(bare[2:4]) + bits(bare[6:])[:covered])
        s = mpeg.scan(frame(bit=bit, mode=mode, layer=layer, crc=right) * 2 + frame(bit=bit, mode=mode, layer=layer, crc=right ^ 1))
        assert (s.right, s.wrong) == (2, 1), (layer, mode)
    # layer II with all subbands in use: two bits each select scale factors
    bare = frame(bit=10, mode=0, layer=2, crc=0, fill=0xFF)
    n = 2 * (4 * 11 + 3 * 12 + 2 * 7) + 2 * 2 * 30
    assert mpeg.scan(frame(bit=10, mode=0, layer=2, fill=0xFF, crc=slow_crc(bits(bare[2:4]) + bits(bare[6:])[:n]))).right == 1
    assert (lambda s: (s.right, s.wrong))(mpeg.scan(frame() * 2)) == (0, 0)


def test_tags_and_tables():
    text = lambda key, value: key + len(value).to_bytes(4, "big") + b"\0\0" + value
    body = text(b"TIT2", b"\x00Song") + text(b"TPE1", b"\x01" + "Bjö".encode("utf-16")) + text(b"APIC", b"\xff" * 300) + text(b"TXXX", b"\x03key\0value") + bytes(20)
    n = len(body)
    head = b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body
    tail = b"TAG" + b"Old".ljust(30, b"\0") + b"Someone".ljust(30, b"\0") + bytes(65)
    ape = (4).to_bytes(4, "little") + bytes(4) + b"Mood\0calm"
    ape += b"APETAGEX" + (2000).to_bytes(4, "little") + (len(ape) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    info = bytearray(frame())
    info[4 + 17 : 4 + 17 + 16] = b"Info" + (3).to_bytes(4, "big") + (3).to_bytes(4, "big") + (1668).to_bytes(4, "big")
    info[4 + 17 + 16 : 4 + 17 + 20] = b"LAME"
    info[4 + 17 + 16 + 21 : 4 + 17 + 16 + 24] = bytes([0x24, 0x04, 0x80])  # 576 before, 1152 behind
    s = mpeg.scan(head + bytes(info) + frame() * 3 + ape + tail)
    assert s.tags == {"TIT2": "Song", "TPE1": "Bjö", "key": "value", "title": "Old", "artist": "Someone", "Mood": "calm"} and s.skipped == 0
    assert s.table == {"kind": "Info", "frames": 3, "bytes": 1668, "delay": 576, "padding": 1152} and s.duration == Fraction(3 * 1152 - 576 - 1152, 44100)
    vbri = bytearray(frame())
    vbri[36:62] = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (1668).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\3" + b"\0\1" + b"\0\2" + b"\0\1"
    vbri[62:68] = (417).to_bytes(2, "big") * 3
    s = mpeg.scan(bytes(vbri) + frame() * 3)
    assert s.table == {"kind": "VBRI", "frames": 3, "bytes": 1668, "frames_a_place": 1, "places": [0, 417, 834]} and len(s.offsets) == 3


def test_media_columns(spark):
    texts = [(1, "a"), (2, None), (3, ""), (4, "é" * 70_000), (5, "a"), (None, "x" * 64), (5, "a"), (6, "TAG" * 500 + "ÿ")]
    df = spark.createDataFrame([(*t, 1, "m") for t in texts], "doc_id long, text string, id int, media string")
    stored = media.store(df)
    got = {(r["id"], r["n_bytes"]): r for r in media.read_back(stored).collect()}
    assert stored.count() == len(texts) and stored.columns == ["id", "n_bytes", "media"]
    for i, t in texts:
        data = (t or "").encode()
        whole = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r["media_sha256"] == hashlib.sha256(mpeg.write(whole)).hexdigest() and "table=Xing" in r["feature"]
    assert media.store(df.limit(0)).count() == 0 and media.read_back(media.store(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, bytearray(frame() * 3)), (2, None), (3, bytearray(b"")), (4, bytearray(b"junk"))], "k long, media binary")
    p = {r["k"]: r["probed"] for r in media.probe(odd).collect()}
    assert p[1]["seek"] == [0, 417, 834] and p[1]["duration"] == str(Fraction(3 * 1152, 44100)) and p[1]["tags"] == {}
    assert [(p[k]["n_frames"], p[k]["seek"], p[k]["version"], p[k]["skipped"]) for k in (2, 3, 4)] == [(0, [], None, 0), (0, [], None, 0), (0, [], None, 4)]


# Conversations.


def cheapest(rows):
    """(cost, audit, repaired) over all edits of [(role, text, fault)], two insertions at most in a row."""
    inserts = [()] + [((None, r),) for r in ("user", "assistant")] + [((None, r), (None, q)) for r in ("user", "assistant") for q in ("user", "assistant")]
    choices = []
    for role, text, fault in rows:
        some = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            some += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        choices += [[("I" * len(x), 3 * len(x), [(r, "") for _, r in x]) for x in inserts], [(e, c, [x] if x else []) for e, c, x in some]]
    choices.append([("I" * len(x), 3 * len(x), [(r, "") for _, r in x]) for x in inserts])
    best = None
    for pick in itertools.product(*choices):
        cost = sum(c for _, c, _ in pick)
        if best and cost > best[0]:
            continue
        out = [x for *_, xs in pick for x in xs]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            found = (cost, "".join(e for e, *_ in pick), out)
            best = min(best, found, key=lambda b: b[:2]) if best else found
    return best


def plain_report(rows):
    nul = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            how = zlib.crc32(f"{nul(c)}:{nul(turn)}".encode()) % 20
            role, text = nul(role), nul(text)
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        cost, audit, repaired = cheapest(faulty)
        n = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def reported(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, conv int, times string")
    got = chats.report(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_conversations(spark, monkeypatch):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ugly"], ["Hi.", "Yes!", "so", " ", None, "Why? ", "x.", "né.\n", "end.\u0085"]
    rows = []
    for conv in [*range(150), None]:
        turns = rng.sample(range(9), rng.randrange(1, 4))
        rows += [(conv, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(1000, 5, "user", "Hi."), (1001, 3, "user", "a."), (1001, 3, "user", "a."), (1001, 3, "assistant", "b.")]
    want = plain_report(rows)
    assert reported(spark, rows) == want
    assert any(w[6] == "" for w in want.values()) and len({w[5] for w in want.values()}) > 5
    monkeypatch.setattr(chats.repair, "__defaults__", (1,))  # each row a part of its own
    assert reported(spark, rows) == want
    assert reported(spark, []) == {}


def test_long_conversation_in_parts(spark):
    """Composed in parts, or in one, the weights are the same; identical rows are taken at once."""
    rng = random.Random(8)
    rows = [(7, t // 3, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", f"t{t}."])) for t in range(3000)]
    rows += [(7, 500, "user", "again.")] * 400
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    one, many = (chats.repair(chats.counted(df), part).collect() for part in (10**6, 17))
    assert one == many and len(one) == 1 and one[0]["duplicate"] > 399
    audit = one[0]["audit"]
    assert len(audit) - audit.count("I") == len(rows)
    # applied, the edits give the roles' grammar and the cost that is said
    seen, cost, left = set(), 0, []
    for t, role, text in sorted((t, r, x) for _, t, r, x in rows):
        left.append((role, text, "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] != "." else ""))
        seen.add((role, text))
    at = iter(left)
    for e in audit:
        fault = next(at)[2] if e != "I" else ""
        cost += {"K": 0, "R": 3, "D": 4, "I": 3}[e] + 3 * (e in "KR" and fault == "truncated")
        assert e == "D" or fault not in ("blank", "duplicate")
    assert cost == one[0]["cost"]
    out = list(chats.repaired_rows(audit, ((r, t, 1) for r, t, _ in left)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest() == one[0]["repaired_sha256"]


def test_queries_run(spark):
    for name in ("op12_mpeg", "op13_conversations"):
        assert queries.queries()[name](spark, SF).count() > 0
