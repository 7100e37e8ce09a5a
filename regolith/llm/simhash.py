"""SimHash near-duplicates: fingerprints, multi-index hashing, components.

A fingerprint has 64 bits; bit i is set if it is set in over half of the hashes (XXH64, seed 42) of the text's shingles.
Fingerprints of at most `distance` differing bits are linked. The 64 bits are cut into m segments and segment i is
probed with every value of a Hamming ball of radius t_i, where the radii sum to distance - m + 1: if each segment differed
in more than t_i bits, all would differ in more than `distance`. So the probes of one fingerprint find every linked one
in the tables of the others' segments, and complete distances are then verified. m is 3 up to WIDE distinct fingerprints
and 2 beyond, where wider segments keep the tables' buckets small; the links found are the same.

Equal fingerprints are one entry. Where very many share a segment's value they are told apart by parts of the whole
fingerprint, so that a popular value is not compared all with all. Within a shard, links are reduced to a spanning forest before they leave it, so that a
group of near copies yields as many edges as it has members and not all its pairs.

Defined results: null and wordless texts have fingerprint zero, which is linked like any other; fewer words than a
shingle make one shingle of them all; null ids are never the smallest id unless a component has no other; repeated rows
each get their row; texts of any length are read whole; further columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, dump_arrays, load_arrays, lower_ascii, materialize, release, rows_with_key, to_bytes
from .graph import components
from .xxh import xxh64

#: Distinct fingerprints from which two segments of 32 bits are used.
WIDE = 20_000_000
#: Entries of one key from which probes must also agree in a part of the whole fingerprint.
HOT = 2000
_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def fingerprint_many(texts: list, shingle: int = 4) -> np.ndarray:
    """Fingerprints (unsigned) of texts, hashed together."""
    lines = [b" ".join(lower_ascii(to_bytes(t)).split()) for t in texts]
    out = np.zeros(len(lines), np.uint64)
    some = [i for i, x in enumerate(lines) if x]
    if not some:
        return out
    buffer = b" ".join(lines[i] for i in some) + b" "
    ends = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.concatenate([[0], np.cumsum(np.fromiter((lines[i].count(b" ") + 1 for i in some), np.int64, len(some)))])
    # shingles from every word that has enough words of its own text after it; the whole of a shorter text
    text_end = np.repeat(first[1:], np.diff(first))
    word = np.arange(len(starts))
    begin = np.flatnonzero((word + shingle <= text_end) | np.isin(word, first[:-1]))
    last = np.minimum(begin + shingle, text_end[begin]) - 1
    h = xxh64(buffer, starts[begin], ends[last], 42)
    out[some] = majority(h, np.searchsorted(begin, first[:-1]))
    return out


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of h (first: where it begins) the bits set in over half of it.

    Eight byte-wide counters are summed in one word, over at most 255 hashes at a time.
    """
    sizes = np.diff(np.append(first, len(h)))
    steps = (sizes + 254) // 255
    head = np.concatenate([[0], np.cumsum(steps)[:-1]])
    cuts = np.repeat(first, steps) + 255 * (np.arange(steps.sum()) - np.repeat(head, steps))
    parts = h.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(first), 8), np.uint8)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[parts[:, byte]], cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        out[:, byte] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64).ravel()


def fingerprint(text: object, shingle: int = 4) -> int:
    return int(fingerprint_many([text], shingle)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_key, fp): the hash of the text, which with the id names the row, and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint_many(part, shingle) for part in by_size(batch.column("text").to_pylist())]
            fp = np.concatenate([np.zeros(0, np.uint64), *fp]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(fp)], ["id", "text_key", "fp"])
        release()

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key long, fp long")


def plan(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) for each segment."""
    if segments > distance + 1:
        raise ValueError("more segments than distance + 1")
    spare, cuts = distance - segments + 1, [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a, spare // segments + (i < spare % segments)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with at most `radius` set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _spread(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Join the sets of a and b (parent: each node's root, the smallest of its set)."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def shard_edges(table: dict[int, tuple[np.ndarray, np.ndarray]], probes: dict[int, tuple[np.ndarray, np.ndarray]], distance: int, step: int = 4_000_000, hot: int = HOT):
    """Spanning forest of the links between probes and table entries: per segment (keys, fingerprints).

    A probe meets all entries of its key. Where these are over `hot`, it meets those that also agree in one of distance + 1
    parts of the whole fingerprint: linked ones differ in `distance` bits at most, so they agree in some part.
    """
    every = np.unique(np.concatenate([x[1] for x in (*table.values(), *probes.values())]))
    parent = np.arange(len(every))

    def compare(tk, tf, pk, pf):
        """tk sorted; tf, pf: places in `every`."""
        nonlocal parent
        lo, hi = np.searchsorted(tk, pk, "left"), np.searchsorted(tk, pk, "right")
        some = hi > lo
        lo, size, pf = lo[some], (hi - lo)[some], pf[some]
        ends = np.cumsum(size)
        at, done = 0, 0
        while at < len(size):
            # as many probes as give `step` candidates; one probe with more goes in pieces
            to = max(at + 1, int(np.searchsorted(ends, done + step, "right")))
            n, first = size[at:to], lo[at:to]
            total = int(n.sum())
            for cut in range(0, total, 4 * step):
                k = np.arange(cut, min(total, cut + 4 * step))
                own = np.searchsorted(np.cumsum(n), k, "right")
                a = pf[at:to][own]
                b = tf[first[own] + k - (np.cumsum(n) - n)[own]]
                keep = parent[a] != parent[b]
                a, b = a[keep], b[keep]
                near = np.bitwise_count(every[a] ^ every[b]) <= distance
                parent = _roots(len(every), a[near], b[near], parent)
            done += total
            at = to

    for seg, (pk, pf) in probes.items():
        if seg not in table:
            continue
        tk, tf = table[seg]
        tf, pf = np.searchsorted(every, tf), np.searchsorted(every, pf)
        keys, of, size = np.unique(tk, return_inverse=True, return_counts=True)
        much = size > hot
        place = np.minimum(np.searchsorted(keys, pk), len(keys) - 1)
        asked = keys[place] == pk
        cold = np.flatnonzero(~much[of])
        order = cold[np.argsort(tk[cold], kind="stable")]
        few_ = asked & ~much[place]
        compare(tk[order], tf[order], pk[few_], pf[few_])
        if much.any():
            held, many = np.flatnonzero(much[of]), np.flatnonzero(asked & much[place])
            cuts = [64 * j // (distance + 1) for j in range(distance + 2)]
            for low, high in zip(cuts, cuts[1:]):
                part = lambda x: (every[x] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)  # noqa: B023, E731
                tkey = (of[held].astype(np.uint64) << np.uint64(high - low)) | part(tf[held])
                order = np.argsort(tkey, kind="stable")
                compare(tkey[order], tf[held][order], (place[many].astype(np.uint64) << np.uint64(high - low)) | part(pf[many]), pf[many])
    away = parent != np.arange(len(every))
    return every[away], every[parent[away]]


def links(distinct: DataFrame, distance: int, segments: int, shards: int) -> DataFrame:
    """Edges (a, b) that connect what links connect, from a table of distinct fp."""
    parts = plan(segments, distance)

    def emit(frames):
        for f in frames:
            fp = f["fp"].to_numpy().astype(np.uint64)
            rows: dict[int, dict[str, np.ndarray]] = {}
            for seg, (shift, width, radius) in enumerate(parts):
                own = (fp >> np.uint64(shift)) & np.uint64(2**width - 1)
                masks = ball(width, radius)
                keys = (own[:, None] ^ masks[None, :]).ravel()
                for kind, ks, fs in (("t", own, fp), ("p", keys, np.repeat(fp, len(masks)))):
                    s = (_spread(ks + np.uint64(seg)) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(s, kind="stable")
                    cut = np.searchsorted(s[order], np.arange(shards + 1))
                    for i in np.flatnonzero(np.diff(cut)):
                        pick = order[cut[i] : cut[i + 1]]
                        rows.setdefault(int(i), {}).update({f"{kind}{seg}k": ks[pick], f"{kind}{seg}f": fs[pick]})
            yield pd.DataFrame({"s": list(rows), "data": [dump_arrays(**x) for x in rows.values()]})

    def join(frame):
        got = [load_arrays(x) for x in frame["data"]]
        sides = {kind: {} for kind in "tp"}
        for kind in sides:
            for seg in range(len(parts)):
                if held := [x for x in got if f"{kind}{seg}k" in x]:
                    sides[kind][seg] = tuple(np.concatenate([x[f"{kind}{seg}{c}"] for x in held]) for c in "kf")
        a, b = shard_edges(sides["t"], sides["p"], distance)
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    asked = distinct.select("fp").mapInPandas(emit, "s int, data binary").repartition(shards, "s")
    return asked.groupBy("s").applyInPandas(join, "a long, b long")


def classes(distinct: DataFrame, distance: int, segments: int | None) -> DataFrame:
    """distinct (fp, least), one row per fingerprint, with its root: the smallest fingerprint linked to it, directly or not."""
    n = distinct.count()
    segments = segments or (2 if n > WIDE else 3)
    probes = sum(len(ball(w, t)) for _, w, t in plan(segments, distance))
    shards = int(max(12, min(65536, n * probes / 300_000)))
    roots = components(links(distinct, distance, segments, shards))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return materialize(named, "simhash-classes")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id linked to it, directly or not)."""
    rows = materialize(fingerprints(documents, id_col, text_col, shingle).drop("text_key"), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fp")
    found = classes(distinct, distance, segments)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """One document of each component, that of the smallest id (null last), with all its columns.

    A document is named by its id and the hash of its text, since ids may be null or repeat.
    """
    rows = fingerprints(documents, id_col, text_col, shingle)
    distinct = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("least")), "simhash-fp")
    keep = classes(distinct, distance, segments).groupBy("root").agg(F.min("least").alias("least"))
    keep = keep.select(F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key"))
    whole = rows_with_key(documents, id_col, text_col)
    kept = whole.join(keep, whole["id"].eqNullSafe(keep["id"]) & (whole["text_key"] == keep["text_key"]), "left_semi")
    return kept.dropDuplicates(["id", "text_key"]).select("row.*")
