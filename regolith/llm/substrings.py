"""Substring dedup by suffix automata over reference shards.

A word goes if a window of `window` words over it also starts in a document with a smaller id.

1. Blocks of documents winnow their texts (4-word hashes, 10 a window of 13), so two texts that share a window share a kept
   hash at the same words of it. Each distinct hash of a block is one row; Spark finds the hashes that several documents
   have and, for each, the place in its owner, the document of the smallest id: 64 words of it are one reference shard.
2. Blocks cut the passages around shared hashes and send each distinct one, with the places where the block has it, to its
   reference shard. A shard's passages arrive in order of id. Each is streamed through the suffix automaton of the
   passages of smaller ids, which gives its matching statistics; maximal spans of `window` words or more are covered.
   Then it is added to the automaton itself. A passage that a smaller id has already is covered whole.
3. Blocks get the covered spans back, remove them, and return the rest.

Broadcasting every automaton to every document would cost shards x documents; routing sends a document only to the shards
that can match it. A hash that over HOT documents have would make one large shard of many different contexts: around it
each window is a passage and a shard of its own, so that its contexts spread and only equal windows, one row a block,
meet. A task holds the automaton of one shard at a time and streams through the rest. Words are compared by 40 bits of a
hash of each of the 13 words.

Defined results: null text has no words; texts below 13 words keep all; rows of equal id do not remove each other; a null
id counts as smaller than any other; ids are integers; repeated rows each get their row; texts of any length are read
whole; further columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_block, columns_of, deliver, dump_arrays, keyed, load, load_arrays, pack, release, shards_for, to_bytes
from .wordhash import Words, grams, mix

#: Words of an owner document that form one reference shard.
REFERENCE = 64
#: Documents that may have a hash before its windows become shards of their own.
HOT = 2000
_LOW = np.int64(-(2**63))
_WORD_BYTES = 5
_RATIO = np.uint64(0x9E3779B97F4A7C15)


def winnow(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept places, their hashes, and the text of each word."""
    text = words.text_of()
    h = words.hashes()
    g, w = grams(h, k), window - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), text
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    low[text[:n] != text[window - 1 : window - 1 + n]] = 0  # no window of one text
    best = np.zeros(len(g), np.uint64)
    for j in range(w):
        np.maximum(best[j : j + n], low, out=best[j : j + n])
    kept = np.flatnonzero((best == g) & (g != 0))
    return kept, g[kept], text


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_LOW if x is None else x for x in table["id"].to_pylist()], np.int64)


def _kept(table: pa.Table, window: int, k: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, kept places, their distinct hashes and which of these each place has."""
    words = Words([to_bytes(t) for t in table["text"].to_pylist()])
    kept, g, _ = winnow(words, window, k)
    distinct, inverse = np.unique(g, return_inverse=True)
    return words, kept, distinct, inverse


def shared_hashes(packed: DataFrame, window: int, k: int, hot: int) -> DataFrame:
    """(b, key, route, hot) for the hashes of each block that documents of different ids have."""

    def rows(table):
        words, kept, distinct, inverse = _kept(table, window, k)
        ids, text = _ids(table), words.text_of()
        own, place = ids[text[kept]], kept - words.first[text[kept]]
        order = np.lexsort((place, own, inverse))
        head = np.flatnonzero(np.diff(inverse[order], prepend=-1))
        low = own[order][head]
        high = own[order][np.append(head[1:], len(order)) - 1] if len(head) else low
        # one number for the place's reference shard, how often the block has the hash, and whether in several documents
        n = np.diff(np.append(head, len(order)))
        return distinct.view(np.int64), low, ((place[order][head] // REFERENCE) << 32) | (n << 1) | (high != low)

    same = Window.partitionBy("key")
    found = keyed(packed, rows, "key long, low long, info long")
    n = F.shiftright(F.col("info"), 1).bitwiseAND(0x7FFFFFFF)
    found = found.select("b", "key", F.min(F.struct("low", "info")).over(same).alias("owner"), F.max("low").over(same).alias("high"), F.max(F.col("info").bitwiseAND(1)).over(same).alias("many"), F.sum(n).over(same).alias("n"))
    found = found.filter((F.col("many") > 0) | (F.col("high") > F.col("owner.low")))
    return found.select("b", "key", F.xxhash64("owner.low", F.shiftright(F.col("owner.info"), 32)).alias("route"), (F.col("n") > hot).alias("hot"))


def passages(words: Words, kept: np.ndarray, route: np.ndarray, hot: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, route) of spans of words around shared hashes, merged where they go to one reference shard."""
    some = np.flatnonzero(~hot)
    at, to = kept[some], route[some]
    text = words.text_of()[at]
    start, end = np.maximum(at - (window - k), words.first[text]), np.minimum(at + window, words.first[text + 1])
    fresh = np.ones(len(at), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (to[1:] != to[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    parts = [(text[head], start[head], end[tail] if len(head) else end[:0], to[head])]
    if hot.any():
        begin = np.unique((kept[hot][:, None] - np.arange(window - k + 1)[None, :]).ravel())
        own = words.text_of()[np.maximum(begin, 0)]
        ok = (begin >= words.first[own]) & (begin + window <= words.first[own + 1])
        begin, own = begin[ok], own[ok]
        parts.append((own, begin, begin + window, mix(grams(words.hashes(), window)[begin] + _RATIO).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def cut(table: pa.Table, got: pa.Table, b: int, window: int, k: int) -> dict:
    """The block's distinct passages, one row each: shard, smallest id, words, and where the block has it."""
    words, kept, distinct, inverse = _kept(table, window, k)
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    at = np.searchsorted(keys[order], distinct)
    at[at == len(keys)] = 0
    shared = (keys[order][at] == distinct if len(keys) else np.zeros(len(distinct), bool))[inverse]
    pick = order[at[inverse[shared]]] if len(keys) else np.zeros(0, np.int64)
    text, start, end, to = passages(words, kept[shared], got["route"].to_numpy()[pick], got["hot"].to_numpy(zero_copy_only=False)[pick].astype(bool), window, k)
    h = words.hashes()
    # equal passages on the same route once: by a hash over their words
    total = np.zeros(len(h) + 1, np.uint64)
    powers, back = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)])) for x in (_RATIO, np.uint64(pow(int(_RATIO), -1, 2**64))))
    np.cumsum(mix(h) * powers[:-1], out=total[1:])
    same = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)) ^ mix(to.view(np.uint64))
    _, first, which = np.unique(same, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(first) + 1))
    ids, data = _ids(table), np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES]
    place = (start - words.first[text]).astype(np.uint32)
    low, occ, body = [], [], []
    for i, f in enumerate(first.tolist()):
        own = order[cuts[i] : cuts[i + 1]]
        own_ids = ids[text[own]]
        low.append(own_ids.min())
        occ.append(text[own].astype("<u4").tobytes() + place[own].tobytes() + own_ids.astype("<i8").tobytes())
        body.append(data[start[f] : end[f]].tobytes())
    return {"b": np.full(len(first), b, np.int64), "route": to[first], "low": np.array(low, np.int64), "words": body, "places": occ}


class Automaton:
    """A generalised suffix automaton that grows by whole sequences."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, seq: list[int]) -> None:
        step, link, size = self.step, self.link, self.size
        last = 0
        for c in seq:
            p, q, at = last, step[last].get(c), -1
            if q is None:
                at = last = len(step)
                step.append({})
                size.append(size[p] + 1)
                link.append(0)
                while p >= 0 and c not in step[p]:
                    step[p][c] = at
                    p = link[p]
                if p < 0:
                    continue
                q = step[p][c]
            if size[q] != size[p] + 1:
                clone = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            if at >= 0:
                link[at] = q
            else:
                last = q

    def covered(self, seq: list[int], window: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of the sequence's matches of at least `window` items."""
        step, link, size = self.step, self.link, self.size
        spans: list[tuple[int, int]] = []
        state = n = 0
        for i, c in enumerate(seq, 1):
            while state and c not in step[state]:
                state = link[state]
                n = size[state]
            state = step[state].get(c, 0)
            n = n + 1 if state else 0
            if n >= window:
                if spans and i - n <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], i - n), i)
                else:
                    spans.append((i - n, i))
        return spans


def _decode(data: bytes) -> list[int]:
    cells = np.zeros((len(data) // _WORD_BYTES, 8), np.uint8)
    cells[:, :_WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _WORD_BYTES)
    return cells.view("<u8").ravel().tolist()


def stream(batches, window: int):
    """Rows in order of (route, low), one shard after the other: (b, spans) of what is covered."""
    route = None
    for batch in batches:
        out_b, out = [], []
        for b, to, low, data, places in zip(*(batch.column(c).to_pylist() for c in ("b", "route", "low", "words", "places"))):
            if to != route:
                route, automaton, known, fresh, level = to, Automaton(), {}, [], None
            if low != level:
                for seq in fresh:
                    automaton.add(seq)
                fresh, level = [], low
            if data not in known:
                seq = _decode(data)
                known[data] = low, automaton.covered(seq, window)
                fresh.append(seq)
            least, spans = known[data]
            size, n = len(data) // _WORD_BYTES, len(places) // 16
            text, at, ids = np.frombuffer(places, "<u4", n), np.frombuffer(places, "<u4", n, 4 * n).astype(np.int64), np.frombuffer(places, "<i8", n, 8 * n)
            whole = (ids > least) & (size >= window)
            part = np.flatnonzero(~whole) if spans else np.zeros(0, np.int64)
            if whole.any() or len(part):
                cover = [(text[whole], at[whole], at[whole] + size), *((text[part], at[part] + x, at[part] + y) for x, y in spans)]
                out_b.append(b)
                out.append(dump_arrays(**{name: np.concatenate(x).astype(np.uint32) for name, x in zip(("text", "begin", "stop"), zip(*cover))}))
        yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out, pa.binary())], ["b", "spans"])
    release()


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 4, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked for, the kept text (words joined by blanks)."""
    kind = documents.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be integers, which say which document comes first")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = pack(rows, ["id", "text"], "substring-blocks")
    blocks = shards_for(packed)
    schema = "b long, route long, low long, words binary, places binary"

    def request(left, right):
        return columns_of(schema, cut(load(left["data"][0].as_py()), right, left["b"][0].as_py(), window, k))

    asked = by_block(packed, shared_hashes(packed, window, k, hot), request, schema, blocks)
    dealt = asked.repartition(blocks, "route").sortWithinPartitions("route", "low")
    covered = dealt.mapInArrow(lambda batches: stream(batches, window), "b long, spans binary")

    def finish(table, got):
        gone: dict[int, list[tuple[int, int]]] = {}
        for x in map(load_arrays, got["spans"].to_pylist()):
            for t, a, z in zip(x["text"].tolist(), x["begin"].tolist(), x["stop"].tolist()):
                gone.setdefault(t, []).append((a, z))
        n_words, n_removed, sha, kept = [], [], [], []
        for i, text in enumerate(table["text"].to_pylist()):
            words = to_bytes(text).split()
            left = words
            if i in gone:
                keep = np.ones(len(words), bool)
                for a, z in gone[i]:
                    keep[a:z] = False
                left = [w for w, y in zip(words, keep.tolist()) if y]
            rest = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "surrogatepass") if with_text else None)
        return {"id": table["id"], "n_words": n_words, "n_removed": n_removed, "kept_sha256": sha, "kept": kept}

    done = deliver(packed, covered, finish, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text, blocks)
    return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
