"""Language-model scores from a trigram trie in Elias-Fano levels.

Texts are lower-cased (A-Z); a token is a word or the end of a text, and each text begins after an end. The first order
gives the share of a token among the training tokens, less the mass of tokens seen once, which is left to unknown words.
The second and third orders hold all pairs and triples that occur in training, smoothed with pseudo-counts shared out by
the order below (`least` would leave out those that occur less often; it is 1, which leaves out none):

    p(w | v) = (c(v w) + PRIORS[0] p(w)) / (c(v) + PRIORS[0]),  p(w | u v) = (c(u v w) + PRIORS[1] p(w | v)) / (c(u v) + PRIORS[1])

For what is not in the trie the count is taken as 0, and a context that is not in it leaves the order below as it is.

Each order is dealt to shards by context, a context with many tokens to several of them by successor. A shard's levels are
the contexts, monotone pointers to their successors, the successors made monotone by adding the last value before their
range (all three in Elias-Fano form), and probabilities in one byte each. They are written to a file and memory-mapped, and
queried by successor search relative to the range of the context, value by value in the compact form. The search decides
whether an n-gram is in the trie, and the place that it finds is where probability, count and id are. Blocks of documents
ask shards first for counts and ids of their distinct words, then for their distinct pairs of known words, then for their
distinct triples of known pairs (a triple is in the trie only if its pairs are), whether the training texts have them or
not, so that nothing is sent once per token.

Defined results: null text is empty and has its end alone; a null id is in training; repeated rows each count and each get
their row; texts of any length are read whole, one block each if need be; further columns may have any name; empty tables
give no rows; with nothing to learn from every probability is 1.
"""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answer, ask, dump, dump_arrays, forget, least_of, load, load_arrays, lower_ascii, materialize_blocks, narrow, pack, reclaim, release, shards_for, tell, to_bytes
from .wordhash import Words, mix

#: Pseudo-counts of the order below in each context, for pairs and for triples.
PRIORS = (3000.0, 50.0)
#: Training occurrences from which words, pairs and triples are in the higher orders: all that occur.
LEAST = 1
END = np.uint64(1)


#: Fields of 1, 2 and 4 low ones in every 2, 4 and 8 bits; a one in every byte, and its top bit.
_EACH = {2: np.uint64(0x5555555555555555), 4: np.uint64(0x3333333333333333), 8: np.uint64(0x0F0F0F0F0F0F0F0F)}
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: By rank and byte: the place of the one of that rank.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[rank] for rank in range(8) for byte in range(256)], np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and how many zeros come before each run of RUN bits.

    Single values are got and sought where they lie; nothing is decoded as a whole.
    """

    RUN = 64

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self.lanes = np.ndarray((max(0, len(low) - 7),), "<u8", low, 0, (1,)) if len(low) > 7 else np.zeros(0, np.uint64)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1] + np.uint64(1)) // max(n, 1)).bit_length() - 1) if n else 0
        low = np.append(np.packbits(_to_bits(values, bits), bitorder="little"), np.zeros(8, np.uint8))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        runs = (int(ones[-1]) + 2 if n else 1) // cls.RUN + 1
        line = np.zeros(runs * cls.RUN, np.uint8)
        line[ones] = 1
        high = np.packbits(line, bitorder="little").view("<u8")
        zeros = cls.RUN * np.arange(runs) - np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(runs, -1).sum(axis=1, dtype=np.int64))[:-1]])
        return cls(n, bits, low, high, zeros.astype(np.int64))

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Places in the unary line of the ones (or zeros) of these ranks."""
        before = self.RUN * np.arange(len(self.zeros)) - self.zeros if ones else self.zeros
        run = np.searchsorted(before, rank, "right") - 1
        word = self.high[run]
        word = word if ones else ~word
        rest = (rank - before[run]).astype(np.uint64)
        # in each byte of `upto` the ones up to its end; bytes that end before the place are those with no more than `rest`
        upto = word - (word >> np.uint64(1) & _EACH[2])
        upto = (upto & _EACH[4]) + (upto >> np.uint64(2) & _EACH[4])
        upto = (upto + (upto >> np.uint64(4)) & _EACH[8]) * _BYTES
        shift = np.bitwise_count((rest * _BYTES | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)
        rest -= upto << np.uint64(8) >> shift & np.uint64(255)
        return (run << 6) + shift.astype(np.int64) + _IN_BYTE[(rest << np.uint64(8) | word >> shift & np.uint64(255)).astype(np.intp)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.bits
        if self.bits > 56:  # a value may lie in nine bytes
            return (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64) | np.where(bit & 7, self.low[(bit >> 3) + 8].astype(np.uint64) << (np.uint64(64) - (bit & 7).astype(np.uint64)), np.uint64(0))) & np.uint64((1 << self.bits) - 1)
        return (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values of these places."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def range(self, a: int, b: int) -> np.ndarray:
        return self.get(np.arange(a, max(a, min(b, self.n))))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of these values, -1 for those that are not in the sequence, which rises everywhere.

        The values of one high part lie together between two zeros, which are selected once for values that come in a row;
        among them low parts are halved, since a context with many successors has thousands under one high part.
        """
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        top = (values >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.get(np.array([self.n - 1]))[0] >> np.uint64(self.bits))
        open_ = np.flatnonzero(top <= last)
        top, low = top[open_], values[open_] & np.uint64((1 << self.bits) - 1)
        new = np.diff(top, prepend=-1) != 0
        own, of = top[new], np.cumsum(new) - 1
        end = self._select(own, False) - own
        start = np.zeros(len(own), np.int64)
        # the zero before a high part is the one behind the high part before, if that was sought too
        after = np.append(False, own[1:] == own[:-1] + 1)
        start[after] = end[np.flatnonzero(after) - 1]
        rest = np.flatnonzero(~after & (own > 0))
        start[rest] = self._select(own[rest] - 1, False) + 1 - own[rest]
        start, end = start[of], end[of]
        while len(open_):
            some = start < end
            open_, low, start, end = open_[some], low[some], start[some], end[some]
            middle = start + end >> 1
            found = self._low(middle)
            hit, less = found == low, found < low
            out[open_[hit]] = middle[hit]
            start, end = np.where(less, middle + 1, start), np.where(less, end, np.where(hit, start, middle))
        return out


def _to_bits(values: np.ndarray, bits: int) -> np.ndarray:
    raw = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw[:, :bits].ravel()


class Trie:
    """One shard of an order: contexts, pointers, successors and quantised log10 probabilities."""

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, low: float, step: float):
        self.levels, self.codes, self.low, self.step = levels, codes, low, step

    @classmethod
    def build(cls, contexts: np.ndarray, words: np.ndarray, log_p: np.ndarray) -> Trie:
        """From pairs sorted by context, then word, each once."""
        head = np.flatnonzero(np.diff(contexts.astype(np.int64), prepend=-1))
        tail = np.append(head[1:], len(words)) - 1
        last = words[tail].astype(np.uint64) if len(head) else np.zeros(0, np.uint64)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last + np.uint64(1))])[:-1] if len(head) else last
        line = words.astype(np.uint64) + np.repeat(base, np.diff(np.append(head, len(words))))
        low = float(log_p.min()) if len(log_p) else 0.0
        step = (float(log_p.max()) - low) / 254 if len(log_p) else 0.0
        codes = np.rint((log_p - low) / (step or 1.0)).astype(np.uint8) + np.uint8(1)
        levels = {"contexts": EliasFano.build(contexts[head]), "pointers": EliasFano.build(np.append(head, len(words))), "successors": EliasFano.build(line)}
        return cls(levels, codes, low, step)

    def save(self, path: str) -> None:
        parts, head = [], [f"{self.low!r} {self.step!r}"]
        for name in self.LEVELS:
            x = self.levels[name]
            head.append(f"{x.n} {x.bits} {len(x.zeros)} {len(x.high)} {len(x.low)}")
            parts += [x.zeros.tobytes(), x.high.tobytes(), x.low.tobytes().ljust(-(-len(x.low) // 8) * 8, b"\0")]
        with open(path, "wb") as f:
            f.write("\n".join(head).encode().ljust(1024))
            for p in (*parts, self.codes.tobytes()):
                f.write(p)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Memory-mapped: pages are read as queries touch them."""
        data = np.asarray(np.memmap(path, np.uint8, "r"))
        head = bytes(data[:1024]).decode().split("\n")
        low, step = map(float, head[0].split())
        at, levels = 1024, {}
        for name, line in zip(cls.LEVELS, head[1:]):
            n, bits, zeros, high, lows = map(int, line.split())
            cuts = np.cumsum([at, 8 * zeros, 8 * high, lows]).tolist()
            levels[name] = EliasFano(n, bits, data[cuts[2] : cuts[3]], data[cuts[1] : cuts[2]].view("<u8"), data[cuts[0] : cuts[1]].view("<i8"))
            at = cuts[2] + -(-lows // 8) * 8
        return cls(levels, data[at:], low, step)

    def find(self, contexts: np.ndarray, words: np.ndarray, stride: int = 1 << 18) -> np.ndarray:
        """Places of pairs (-1: not in the trie), sought `stride` at a time: the context, its range, and in it the successor
        that the word is, relative to the last value before the range."""
        out = np.full(len(words), -1, np.int64)
        c, p, s = (self.levels[n] for n in self.LEVELS)
        for i in range(0, len(words), stride):
            some = contexts[i : i + stride]
            new = np.append(True, some[1:] != some[:-1])
            own, of = some[new], np.cumsum(new) - 1
            place = c.find(own)
            known = place >= 0
            start, end, base = (np.zeros(len(own), np.int64) for _ in range(3))
            start[known], end[known] = p.get(place[known]).astype(np.int64), p.get(place[known] + 1).astype(np.int64)
            later = start > 0
            base[later] = s.get(start[later] - 1).astype(np.int64) + 1
            some = np.flatnonzero(known[of])
            at = s.find((words[i : i + stride][some].astype(np.int64) + base[of[some]]).astype(np.uint64))
            hit = (at >= start[of[some]]) & (at < end[of[some]])
            out[i + some[hit]] = at[hit]
        return out

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes.astype(np.float64) - 1) * self.step


def is_held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


#: Answers of the pairs' and triples' shards come under numbers of their own.
LEVEL = 1 << 24
REQUESTS = pa.schema([("s", pa.int32()), ("b", pa.int64()), ("data", pa.binary())])


class Block:
    """A block's texts as numbered words."""

    def __init__(self, table):
        self.ids = table["id"]
        self.words = Words([lower_ascii(to_bytes(t)) for t in table["text"].to_pylist()])
        self.held = np.array([is_held_out(x) for x in self.ids.to_pylist()], bool)
        self.keys, self.of = np.unique(np.append(self.words.hashes(), END), return_inverse=True)
        self.end, self.of = self.of[-1], self.of[:-1]
        first = self.words.first
        self.token = np.insert(self.of, first[1:], self.end)
        self.n_tokens = np.diff(first) + 1
        self.train = np.repeat(~self.held, self.n_tokens)

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train], minlength=len(self.keys))

    def dealt(self, shards: int) -> dict[int, np.ndarray]:
        return deal((self.keys % np.uint64(shards)).astype(np.int64), shards)

    def coded(self, got: dict[int, bytes], offsets: np.ndarray, shards: int, least: int = LEAST) -> bytes:
        """The block as numbered words with their counts and ids, which the higher orders need and the text does not."""
        count, ids = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for s, pick in self.dealt(shards).items():
            a = load_arrays(got[s])
            count[pick] = a["n"]
            ids[pick[a["n"] >= least]] = offsets[s] + a["rank"] + 1
        table = dump(pa.table({"id": self.ids, "held": pa.array(self.held), "n": pa.array(self.n_tokens)}))
        arrays = dump_arrays(token=narrow(self.token), token0=least_of(self.token), count=narrow(count), count0=least_of(count), id=ids.astype(np.uint32 if ids.max() < 2**32 else np.int64), end=np.array([self.end]))
        return len(table).to_bytes(8, "little") + table + arrays


class Coded:
    """A block as Block.coded gives it. count, id: of each of its words (-1: not known); token: the word of each token,
    context: the one before it; start: where each text begins."""

    def __init__(self, data: bytes):
        cut = 8 + int.from_bytes(data[:8], "little")
        table, a = load(data[8:cut]), load_arrays(data[cut:])
        self.ids, self.held, self.n_tokens = table["id"], table["held"].to_numpy(zero_copy_only=False).astype(bool), table["n"].to_numpy()
        self.count, self.id = a["count"].astype(np.int64) + a["count0"], a["id"].astype(np.int64) - 1
        self.token = a["token"].astype(np.int64) + a["token0"]
        self.start = np.cumsum(self.n_tokens) - self.n_tokens
        self.context = np.concatenate([a["end"], self.token[:-1]])
        self.context[self.start] = a["end"][0]
        self.train = np.repeat(~self.held, self.n_tokens)

    def pairs(self) -> Asked:
        """The distinct pairs of known words."""
        at = np.flatnonzero((self.id[self.context] >= 0) & (self.id[self.token] >= 0))
        return Asked(self, at, self.context, self.id, self.count)

    def triples(self, pairs: Asked, known: np.ndarray, count: np.ndarray) -> Asked:
        """The distinct triples of known pairs (known: an id of each pair or -1, count: its occurrences)."""
        pair = np.full(len(self.token), -1, np.int64)
        pair[pairs.at] = np.where(known >= 0, np.arange(len(known)), -1)[pairs.of]
        before = np.concatenate([[-1], pair[:-1]])
        before[self.start] = -1
        self.pair_before = before
        return Asked(self, np.flatnonzero((pair >= 0) & (before >= 0)), before, known, count)


class Asked:
    """Distinct (context, word) of a block: at, the tokens concerned; of, which each has; v, w, their ids; cv, the context's
    occurrences; n, how often the pair occurs in the block's training texts."""

    def __init__(self, block: Coded, at: np.ndarray, context: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.at = at
        words = len(block.id)
        local, self.of = distinct(context[at] * words + block.token[at], len(ids) * words)
        self.context, self.word = np.divmod(local, words)
        self.v, self.w, self.cv = ids[self.context], block.id[self.word], counts[self.context]
        self.n = np.bincount(self.of[block.train[at]], minlength=len(local))

    def dealt(self, total: int, shards: int) -> dict[int, np.ndarray]:
        """By context, one with more than a shard's part of the tokens on by word; in order of ids."""
        parts = 1 + self.cv * shards // max(total, 1)
        s = ((mix(self.v.astype(np.uint64)) % np.uint64(shards)).astype(np.int64) + (mix(self.w.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)) % shards
        order = by_ids(self.v, self.w, runs=False)
        return {i: order[pick] for i, pick in deal(s[order], shards).items()}

    def requests(self, b: int, log_below: np.ndarray, total: int, shards: int) -> dict[str, list]:
        """log_below: log10 of what the order below gives for each."""
        rows = {"s": [], "b": [], "data": []}
        for s, pick in self.dealt(total, shards).items():
            v = self.v[pick]
            head = np.flatnonzero(np.diff(v, prepend=-1))
            size = np.diff(np.append(head, len(v)))
            q = np.clip(np.rint(-log_below[pick] * 16), 0, 255).astype(np.uint8)
            later = np.ones(len(v), bool)
            later[head] = False
            w = self.w[pick]
            step = np.diff(w, prepend=0)[later]
            rows["s"].append(s)
            rows["b"].append(b)
            rows["data"].append(dump_arrays(v=v[head], d=narrow(step), d0=least_of(step), c=narrow(self.cv[pick][head]), c0=least_of(self.cv[pick][head]), size=narrow(size), size0=least_of(size), w=w[head].astype(np.uint32 if self.w.max(initial=0) < 2**32 else np.int64), n=narrow(self.n[pick]), n0=least_of(self.n[pick]), q=q))
        return rows

    def answers(self, got: dict[int, bytes], order: int, offsets: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probability (nan: not in the trie), id (-1: not) and occurrences of each."""
        value, known, count = np.full(len(self.v), np.nan), np.full(len(self.v), -1, np.int64), np.zeros(len(self.v), np.int64)
        for s, pick in self.dealt(total, shards).items():
            a = load_arrays(got[s + order * LEVEL])
            low, step = a["scale"]
            yes = a["codes"] > 0
            value[pick[yes]] = low + (a["codes"][yes].astype(np.float64) - 1) * step
            if "rank" in a:
                known[pick[yes]] = offsets[s] + a["rank"].astype(np.int64)
                count[pick[yes]] = a["n"].astype(np.int64) + a["n0"]
        return value, known, count


def query(blobs: list[bytes], prior: float, with_ids: bool, least: int = LEAST) -> list[bytes]:
    """A shard of an order: its trie, built from what the requests' training texts have, and asked for all that the requests
    name; then how many it holds."""
    got = [load_arrays(x) for x in blobs]
    sizes = [x["size"].astype(np.int64) + x["size0"] for x in got]
    v = np.concatenate([np.repeat(x["v"], n) for x, n in zip(got, sizes)])
    w = np.concatenate([successors(x, n) for x, n in zip(got, sizes)])
    order = by_ids(v, w)
    first = np.ones(len(v), bool)
    first[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
    head = np.flatnonzero(first)
    n = np.add.reduceat(np.concatenate([x["n"].astype(np.int64) + x["n0"] for x in got])[order], head)
    at, n = order[head][n >= least], n[n >= least]
    c = np.concatenate([np.repeat(x["c"].astype(np.int64) + x["c0"], k) for x, k in zip(got, sizes)])[at].astype(np.float64)
    p = 10.0 ** -(np.concatenate([x["q"] for x in got])[at] / 16.0)
    trie = Trie.build(v[at], w[at], np.log10((n + prior * p) / (c + prior)))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "trie")
        trie.save(path)
        trie = Trie.open(path)
        # all that is asked, each once and in order, so that pages are touched once, however many blocks ask
        place = trie.find(v[order[head]], w[order[head]])
        codes = np.where(place >= 0, trie.codes[np.maximum(place, 0)], 0).astype(np.uint8) if len(n) else np.zeros(len(place), np.uint8)
    which = np.empty(len(v), np.int64)
    which[order] = np.cumsum(first) - 1
    scale, out = np.array([trie.low, trie.step]), []
    for part in np.split(which, np.cumsum([len(x["n"]) for x in got])[:-1]):
        own = place[part]
        own = own[own >= 0]
        ids = {"rank": own.astype(np.uint32), "n": narrow(n[own]), "n0": least_of(n[own])} if with_ids else {}
        out.append(dump_arrays(codes=codes[part], scale=scale, **ids))
    return [*out, dump_arrays(held=np.array([len(n)], np.int64))]


def successors(x: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The words of a request: those of each context rise from its first one."""
    head = np.cumsum(sizes) - sizes
    w = np.zeros(int(sizes.sum()), np.int64)
    later = np.ones(len(w), bool)
    later[head] = False
    w[later] = x["d"].astype(np.int64) + x["d0"]
    own = np.cumsum(w)
    return own + np.repeat(x["w"].astype(np.int64) - own[head], sizes)


def distinct(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 to below, each once and in order, and which of them each place has."""
    order = ordered(keys, below)
    if order is None:
        return np.unique(keys, return_inverse=True)
    new = np.append(True, np.diff(keys[order]) != 0)[: len(keys)]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return keys[order[new]], of


def ordered(keys: np.ndarray, below: int) -> np.ndarray | None:
    """Stable order of keys from 0 to below that leave room for a place beside them, as plain numbers are sorted fastest."""
    bits = len(keys).bit_length()
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1) if below << bits < 2**63 else None


def by_ids(v: np.ndarray, w: np.ndarray, runs: bool = True) -> np.ndarray:
    """Order by v, then w. runs: as requests come, which are merged; else each pair is there once, in no order."""
    words = int(w.max(initial=0)) + 1
    below = (int(v.max(initial=0)) + 1) * words
    if below < 2**63 and (order := ordered(v.astype(np.int64) * words + w, below)) is not None:
        return order
    if len(v) and int(v.max()) < 2**31 and int(w.max()) < 2**32:
        return np.argsort((v << 32) | w, kind="stable" if runs else None)
    return np.lexsort((w, v))


def deal(s: np.ndarray, shards: int) -> dict[int, np.ndarray]:
    # numbers of two bytes are sorted by their digits
    order = np.argsort(s.astype(np.uint16) if shards <= 1 << 16 else s, kind="stable")
    cuts = np.searchsorted(s[order], np.arange(shards + 1))
    return {int(i): order[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(np.diff(cuts))}


def unigram(count: np.ndarray, total: int, once: int) -> np.ndarray:
    """Probability of words of these counts; 0 is any unknown word."""
    if not total:
        return np.ones(len(count))
    rest = min(0.5, max(once, 1) / (total + 1))
    return np.where(count > 0, (1 - rest) * count / total, rest)


def _offsets(answers: DataFrame, name: str, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the shards of the numbers that each gives of itself, and the ids before each shard's. A few numbers a
    shard come to the driver."""
    own = {r["s"]: load_arrays(r["data"])[name] for r in answers.filter("b = -1").collect()}
    every = np.array([own[s] if s in own else np.zeros_like(next(iter(own.values()))) for s in range(shards)]) if own else np.zeros((shards, 4), np.int64)
    return every.sum(axis=0), np.concatenate([[0], np.cumsum(every[:, -1])]).astype(np.int64)


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", priors: tuple[float, float] = PRIORS, least: int = LEAST) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    least: training occurrences from which n-grams are in the trie; 1 holds all.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    packed = pack(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id", "text"], "ngram-blocks")
    shards = blocks = shards_for(packed)

    def ask_words(b, table):
        x = Block(table)
        n = x.counts()
        return {s: dump_arrays(h=x.keys[pick], n=narrow(n[pick]), n0=least_of(n[pick])) for s, pick in x.dealt(shards).items()}

    def count_words(blobs):
        got = [load_arrays(x) for x in blobs]
        keys, which = np.unique(np.concatenate([x["h"] for x in got]), return_inverse=True)
        n = np.bincount(which, np.concatenate([x["n"].astype(np.int64) + x["n0"] for x in got])).astype(np.int64)
        rank = np.cumsum(n >= least) - 1
        out = []
        for part in np.split(which, np.cumsum([len(x["h"]) for x in got])[:-1]):
            known = part[n[part] >= least]
            out.append(dump_arrays(n=n[part].astype(np.uint32 if n.max() < 2**32 else np.int64), rank=rank[known].astype(np.uint32)))
        return [*out, dump_arrays(stats=np.array([(n > 0).sum(), n.sum(), (n == 1).sum(), (n >= least).sum()], np.int64))]

    words = answer(ask(packed, ask_words, shards), count_words, shards, "ngram-words")
    (types, total, once, _), word_ids = _offsets(words, "stats", shards)
    types, total, once = int(types), int(total), int(once)

    def encode(b, table, got):
        return {"b": [b], "data": [Block(table).coded(got, word_ids, shards, least)]}

    coded = materialize_blocks(tell(packed, words.filter("b <> -1"), encode, "b long, data binary", blocks), "ngram-coded", blocks)
    forget(packed)
    forget(words)
    reclaim(coded.sparkSession)

    def first(x):
        """The block's pairs, and log10 of the first order for each of its words."""
        return x.pairs(), np.log10(unigram(x.count, total, once))

    def second(x, pairs, one, got, pair_ids):
        """Pairs' ids and counts, and log10 of the second order for each token."""
        value, known, count = pairs.answers(got, 1, pair_ids, total, shards)
        log_p = one[x.token] + np.log10(priors[0] / (x.count + priors[0]))[x.context]
        found = value[pairs.of]
        log_p[pairs.at] = np.where(np.isnan(found), log_p[pairs.at], found)
        return known, count, log_p

    def ask_pairs(batches):
        for batch in batches:
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data")):
                pairs, one = first(Coded(data.as_py()))
                yield pa.RecordBatch.from_pydict(pairs.requests(b, one[pairs.word], total, shards), REQUESTS)
        release()

    asked = coded.mapInArrow(ask_pairs, "s int, b long, data binary")
    pairs = answer(asked, lambda blobs: query(blobs, priors[0], True, least), shards, "ngram-pairs")
    _, pair_ids = _offsets(pairs, "held", shards)
    below = pairs.filter("b <> -1").withColumn("s", F.col("s") + LEVEL)

    def ask_triples(b, x, got):
        pairs, one = first(x)
        known, count, log_p = second(x, pairs, one, got, pair_ids)
        triples = x.triples(pairs, known, count)
        low = np.zeros(len(triples.v))
        low[triples.of] = log_p[triples.at]
        return triples.requests(b, low, total, shards)

    asked = tell(coded, below, ask_triples, "s int, b long, data binary", blocks, Coded, placed=True)
    triples = answer(asked, lambda blobs: query(blobs, priors[1], False, least), shards, "ngram-triples")
    every = below.unionByName(triples.filter("b <> -1").withColumn("s", F.col("s") + 2 * LEVEL))

    def finish(b, x, got):
        pairs, one = first(x)
        known, count, log_p = second(x, pairs, one, got, pair_ids)
        triples = x.triples(pairs, known, count)
        value, _, _ = triples.answers(got, 2, pair_ids, total, shards)
        some = np.flatnonzero(x.pair_before >= 0)
        log_p[some] += np.log10(priors[1] / (count + priors[1]))[x.pair_before[some]]
        found = value[triples.of]
        log_p[triples.at] = np.where(np.isnan(found), log_p[triples.at], found)
        base = np.log10((x.count + 1) / (total + types + 1))
        sums = lambda y: np.add.reduceat(y, x.start)
        return {"id": x.ids, "held_out": x.held, "n_tokens": x.n_tokens, "n_known": sums((x.count[x.token] > 0).astype(np.int64)), "train_tokens": np.full(len(x.held), total), "base_score": sums(base[x.token]), "score": sums(np.minimum(log_p, 0.0))}

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tell(coded, every, finish, schema, blocks, Coded, placed=True).withColumnRenamed("id", id_col)
