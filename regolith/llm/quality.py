"""Quality rules: per-text counts, and lines that recur across the documents of a host.

Lines are normalised (trimmed, A-Z lowered, digits made 0, runs of blanks made one) and hashed with their host, which is
the `source` column. Each block of documents gives one row for each distinct line: its hash and how many documents of the
block have it. Spark sums them by hash, so a line in a third of all documents is one row a block, and lines that enough
documents have go back to the blocks by a join. A line goes if over MOST_DOCUMENTS of the host's documents have it, however many the
host has; a document that loses over DEPLETED of its words is rejected.

Defined results: null text has no words and fails the base rules; lines without a word never go and are never repeats; a
null host is a host of its own; repeated rows (equal in id, text and host) count as one document and each get their row;
null ids are ids like others; texts of any length are read whole, one block each if need be; further columns may have
any name; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, deliver, few, keyed, lower_ascii, materialize, pack, shards_for, to_bytes, with_share
from .wordhash import Words, grams

#: Documents of a host that may have a line.
MOST_DOCUMENTS = 20
#: Share of a document's words whose loss rejects it.
DEPLETED = 0.5
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 0.5
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SPACES = regex.compile(rb"[\x20\x09-\x0D]+")


def line_hash(host: bytes, line: bytes) -> int:
    return xxhash.xxh64_intdigest(host + b"\0" + b" ".join(lower_ascii(line).translate(_DIGITS).split()))


def _host(source: object) -> bytes:
    return b"\1" if source is None else b"=" + to_bytes(source)


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of each text."""
    words = Words(texts)
    n = np.diff(words.first)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    begins = sums((words.raw & 0xC0) != 0x80)
    chars = sums(begins[words.end] - begins[words.start])
    symbols = sums(_IS_SYMBOL[words.raw])
    text = words.text_of()
    repeated = np.zeros(len(words), bool)
    g = grams(words.hashes(), 3)
    own = np.flatnonzero(text[: len(g)] == text[2 : 2 + len(g)])
    order = own[np.lexsort((g[own], text[own]))]
    again = np.flatnonzero((g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1]))
    for twice in (order[again], order[again + 1]):
        for j in range(3):
            repeated[twice + j] = True
    rep = sums(repeated)
    at = lambda x, cut: x[cut[1:]] - x[cut[:-1]]
    return {"n_words": n, "word_chars": at(chars, words.first), "n_symbols": at(symbols, words.text_start), "n_repeat_words": at(rep, words.first)}


def _lines(table) -> tuple[list[bytes], list[list[tuple[bytes, int]]]]:
    """Texts, and each text's lines with their hashes (0 for a line without a word)."""
    texts = [to_bytes(t) for t in table["text"].to_pylist()]
    hosts = [_host(s) for s in table["source"].to_pylist()]
    lines = [[(x, line_hash(host, x) if x and not x.isspace() else 0) for x in t.split(b"\n")] for t, host in zip(texts, hosts)]
    return texts, lines


def _documents_by_line(table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines and how many documents of the block have each."""
    _, lines = _lines(table)
    every = [np.fromiter({k for _, k in own if k}, np.uint64) for own in lines]
    keys, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_inverse=True)
    n = np.bincount(of, np.repeat(table["share"].to_numpy(), [len(x) for x in every]), len(keys))
    return keys.view(np.int64), n


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_documents: int = MOST_DOCUMENTS, depleted: float = DEPLETED, with_text: bool = True) -> DataFrame:
    """One row per document: the counts, base_failed, n_lost_words, kept and, if asked for, the text without lost lines."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    rows = with_share(rows, ["id", "text", "source"], "quality-repeats")
    packed = pack(rows, ["id", "text", "source", "share"], "quality-blocks")
    asked = keyed(packed, _documents_by_line, "key long, n double")
    total = asked.groupBy("key").agg(F.round(F.sum("n"), 3).alias("n")).filter(F.col("n") > most_documents)
    total = materialize(total, "quality-lines")
    back = asked.select("b", "key").join(few(total), "key")

    def finish(table, got):
        texts, lines = _lines(table)
        common = set(got["key"].to_numpy().view(np.uint64).tolist())
        parts = [text_counts(run) for run in by_size(texts, 1_000_000)]
        out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        dup, lost, rest = [], [], []
        for own in lines:
            seen: set[bytes] = set()
            twice = gone = 0
            kept = []
            for x, k in own:
                if k:
                    if x in seen:
                        twice += 1
                    seen.add(x)
                    if k in common:
                        gone += len(x.split())
                        continue
                kept.append(x)
            dup.append(twice)
            lost.append(gone)
            rest.append(b"\n".join(kept).decode("utf-8", "surrogatepass") if with_text else None)
        lost = np.array(lost, np.int64)
        failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > 100 * MOST_REPEATED * out["n_words"])
        return {"id": table["id"], **out, "n_dup_lines": dup, "n_lost_words": lost, "base_failed": failed, "kept": ~failed & (lost <= depleted * out["n_words"]), "text": rest}

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, base_failed boolean, kept boolean" + ", text string" * with_text
    return deliver(packed, back, finish, schema, shards_for(packed)).withColumnRenamed("id", id_col)
