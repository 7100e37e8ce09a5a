"""Token ids of whole texts, and their binary files of compressed planes.

A file holds the ids of a run of documents: chunks of CHUNK ids, each transposed to byte planes (or bit planes), every
plane compressed with zstandard on its own, then an index of the chunks (where each begins, its ids and the sizes of its
planes), the documents' ids and counts, and the length of that index. Ids are read back by chunk from the index.

Texts are dealt to tasks by ranges of doc_id, so that file k has smaller ids than file k + 1; a task writes its file to
the shared folder under a name of its own and returns it, and only names that a finished task returned are read. A lost
executor's task is run again under another name.

Encoding keeps the ids that the tokenizers library's model gives for each word. That is exact for byte-level pre-tokens
where blanks are single spaces or newlines; any other text, and any other kind of tokenizer, is encoded whole.

Defined results: null text is like empty text and has the end id alone; null ids come first; rows of equal id are in order
of their text; repeated rows each get their ids; texts of any length are encoded whole; only the named columns are read, so
further ones may have any name; empty tables give no rows and no files.
"""

from __future__ import annotations

import io
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, materialize, release, shared_dir

MAGIC = b"RGPLANE1"
CHUNK = 1 << 16
#: Files whose places are summed up in one task.
FILES_A_RUN = 4096
#: Words kept at most (some 200 bytes each); beyond it the table starts anew.
MOST_WORDS = 500_000
#: Bytes that note which words have been seen (a power of two); only those seen before are kept.
_SEEN = 1 << 22
#: Marks a text's first word, which no blank precedes.
_FIRST = "\x01"
#: Parts of words (such as punctuation) kept at most.
MOST_PIECES = 20_000
# Fixed values of byte-level pre-tokenization: its pattern, and the character that stands for each byte.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _PLAIN else 256 + sum(c not in _PLAIN for c in range(b)) for b in range(256)}
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One per Python worker, which later tasks use again; its tables are bounded."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded table of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._tokenize = self.tokenizer.model.tokenize
        self.newline = self._ids("\n")
        self.marks = {x: self._ids(x) for x in ".,"}
        # the table needs words whose ids do not depend on what stands around them
        probe = "It's one, two.\nThree (4)! we'll na\u00efve 12ab x--y\nfive \u4e2d\u6587 ok"
        self.by_word = len(self.newline) == 1
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()
        if self.by_word:
            self.by_word = self.encode([probe])[0].tolist() == self._ids(probe)
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self):
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.codes = _Codes(self)
        self.seen = bytearray(_SEEN)
        self.kept: list[str] = []
        self.once: list[str] = []
        self.n = 0
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's own model."""
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)
        elif piece[0] == " ":
            piece = "\u0120" + piece[1:]
        return [t.id for t in self._tokenize(piece)]

    def _resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        ids: list[int] = []
        counts = np.zeros(len(words), np.int64)
        known, own, before = self.pieces, self._piece, 0
        for i, word in enumerate(words):
            # a line's first word has its newline; a text's first word a mark that is not part of it; others their blank
            if word[0] == "\n":
                ids += self.newline
                word = word[1:]
            else:
                word = word[1:] if word[0] == _FIRST else " " + word
            if word[1:].isalpha() and word[0] == " ":
                ids += own(word)
            elif word[1:-1].isalpha() and word[0] == " " and word[-1] in ".,":
                ids += own(word[:-1])
                ids += self.marks[word[-1]]
            else:
                for piece in _PIECES.findall(word):
                    got = known.get(piece)
                    if got is None:
                        got = own(piece)
                        if len(known) < MOST_PIECES:
                            known[piece] = got
                    ids += got
            counts[i] = len(ids) - before
            before = len(ids)
        return np.array(ids, np.uint32), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.n > MOST_WORDS:
            self._reset()
        codes: list = []
        look = self.codes.__getitem__
        for t in texts:
            if not t:
                codes.append(np.zeros(0, np.int64))
            elif not self.by_word or any(x in t for x in self.special) or _FIRST in t or " ".join(t.split()) != t.replace("\n", " "):
                codes.append(None)
            else:
                words = (_FIRST + t.replace("\n", " \n")).split(" ")
                codes.append(np.fromiter(map(look, words), np.int64, len(words)))
        for words in (self.kept, self.once):
            ids, counts = self._resolve(words)
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        out = []
        for t, c in zip(texts, codes):
            if c is None:
                out.append(np.array(self._ids(t), np.uint32))
                continue
            c = np.where(c < 0, self.n - 1 - c, c)
            begin = self.ends[c]
            size = self.ends[c + 1] - begin
            total = np.cumsum(size)
            at = np.arange(total[-1] if len(c) else 0) + np.repeat(begin - total + size, size)
            out.append(self.flat[at])
        # words seen for the first time are forgotten again
        for word in self.once:
            self.codes.pop(word, None)
        self.ends = self.ends[: self.n + 1]
        self.flat = self.flat[: self.ends[-1]]
        self.kept, self.once = [], []
        return out


class _Codes(dict):
    """The place of a word in the table; below 0 for words that the table does not keep."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        owner, at = self.owner, hash(word) & (_SEEN - 1)
        if owner.seen[at]:
            code = owner.n
            owner.n += 1
            owner.kept.append(word)
        else:
            owner.seen[at] = 1
            owner.once.append(word)
            code = -len(owner.once)
        self[word] = code
        return code


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of ids (unsigned 32-bit), least first; those of zeros alone at the end are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        cells = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        cells = np.ascontiguousarray(raw.T)
    used = max([i + 1 for i in range(len(cells)) if cells[i].any()], default=0)
    return [c.tobytes() for c in cells[:used]]


def unplanes(parts: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if bits:
        cells = np.zeros((32, n), np.uint8)
        for i, p in enumerate(parts):
            cells[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        return np.ascontiguousarray(np.packbits(cells.T, axis=1, bitorder="little")).view("<u4").ravel()
    raw = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(parts):
        raw[:, i] = np.frombuffer(p, np.uint8)
    return raw.view("<u4").ravel()


class Writer:
    def __init__(self, sink, bits: bool = False, chunk: int = CHUNK, level: int = 3):
        import zstandard

        self.sink, self.bits, self.chunk = sink, bits, chunk
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.left: list[np.ndarray] = []
        self.held = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list = []
        self.counts: list[int] = []
        self.at = sink.write(MAGIC) and len(MAGIC)

    def add(self, doc, ids: np.ndarray):
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            ids = np.concatenate(self.left)
            cut = len(ids) - len(ids) % self.chunk
            for i in range(0, cut, self.chunk):
                self._put(ids[i : i + self.chunk])
            self.left, self.held = [ids[cut:]], len(ids) - cut

    def _put(self, ids: np.ndarray):
        parts = [self.zstd.compress(p) for p in planes(ids, self.bits)]
        self.index.append((self.at, len(ids), [len(p) for p in parts]))
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self, kind: pa.DataType):
        if self.held:
            self._put(np.concatenate(self.left))
        chunks = pa.table({"at": pa.array([x[0] for x in self.index], pa.int64()), "n": pa.array([x[1] for x in self.index], pa.int32()), "planes": pa.array([x[2] for x in self.index], pa.list_(pa.int32()))})
        docs = pa.table({"id": pa.array(self.docs, kind), "n": pa.array(self.counts, pa.int64())})
        tail = b""
        for t in (chunks, docs):
            out = io.BytesIO()
            with pa.ipc.new_stream(out, t.schema) as w:
                w.write_table(t)
            tail += struct.pack("<q", len(out.getvalue())) + out.getvalue()
        self.sink.write(tail + struct.pack("<?q", self.bits, len(tail)) + MAGIC)


class Reader:
    """Random access by chunk, and documents in order."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        end = len(MAGIC) + struct.calcsize("<?q")
        source.seek(size - end)
        foot = source.read(end)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of planes")
        self.bits, n = struct.unpack("<?q", foot[: -len(MAGIC)])
        source.seek(size - end - n)
        tail = source.read(n)
        tables = []
        while tail:
            n = struct.unpack("<q", tail[:8])[0]
            tables.append(pa.ipc.open_stream(tail[8 : 8 + n]).read_all())
            tail = tail[8 + n :]
        self.chunks, self.docs = tables
        self._plan = list(zip(*(self.chunks[c].to_pylist() for c in ("at", "n", "planes"))))

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self._plan[i]
        self.source.seek(at)
        whole = n if not self.bits else (n + 7) // 8
        return unplanes([self.zstd.decompress(self.source.read(s), max_output_size=whole) for s in sizes], n, self.bits)

    def documents(self):
        """(id, ids) in the file's order."""
        held, start, i = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.docs["id"].to_pylist(), self.docs["n"].to_pylist()):
            parts, have = [held[start : start + n]], min(n, len(held) - start)
            start += have
            while have < n:
                held, i = self.chunk(i), i + 1
                start = min(n - have, len(held))
                parts.append(held[:start])
                have += start
            yield doc, np.concatenate(parts)


def _open(uri: str, write: bool):
    fs, path = pafs.FileSystem.from_uri(uri)
    if write:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path)
    return fs.open_input_file(path)


def write_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, bits: bool = False, part_bytes: int = 16_000_000) -> DataFrame:
    """Write the files; returns one row per file in order: part, file, docs, tokens, start (ids in the files before)."""
    spark = documents.sparkSession
    folder, path = shared_dir(spark, "tokens"), tokenizer or default_tokenizer()
    kind = pa.int64() if documents.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    rows = documents.select(F.col(id_col).cast("bigint" if kind == pa.int64() else "string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-total // part_bytes))

    def run(batches):
        sink = writer = name = None
        own = encoder(path)
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, at = batch.column("id").to_pylist(), 0
            for texts in by_size(batch.column("text").to_pylist(), 1_000_000):
                for doc, got in zip(ids[at : at + len(texts)], own.encode(texts)):
                    if writer is None:
                        name = f"{folder}/{part:06d}-{os.urandom(8).hex()}.planes"
                        sink = _open(name, True)
                        writer = Writer(sink, bits)
                    writer.add(doc, np.append(got, np.uint32(end_id)).astype(np.uint32))
                at += len(texts)
        if writer is not None:
            writer.close(kind)
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": [len(writer.docs)], "tokens": [sum(writer.counts)]})
        release()

    dealt = rows.repartitionByRange(int(parts), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = materialize(dealt.mapInArrow(run, "part int, file string, docs long, tokens long"), "token-files")
    # ids in the files before: summed over runs of files, then within a run
    runs = files.withColumn("run", F.floor(F.col("part") / FILES_A_RUN))
    sums = runs.groupBy("run").agg(F.sum("tokens").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums.select("run", "before"), "run")
    return placed.select("part", "file", "docs", "tokens", (F.col("start") + F.col("before")).alias("start"))


def read_tokens(files: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with _open(name, False) as source:
                    rows = []
                    for doc, ids in Reader(source).documents():
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64() if id_kind == "bigint" else pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("file", "start").repartition(n, "file").mapInArrow(run, f"id {id_kind}, start long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Write, read back, and describe each document by what was read."""
    integer = documents.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return read_tokens(write_tokens(documents, id_col, **options), "bigint" if integer else "string").withColumnRenamed("id", id_col)
