"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier on hashed byte n-grams of the lower-cased text
says which way it goes; the language whose codeword has the least weighted logistic loss against the classifiers' margins
wins. A bit's weight is its accuracy on training rows set aside. A prediction is ambiguous where the two best languages
are close. All values of the label column are learnt. Training uses at most PER_LANGUAGE rows of each (fewer where there
are so many languages that all would be more than SAMPLE_ROWS), picked by a hash of id and text over all labelled rows;
executors turn their whole texts into n-gram counts, at most 2**BITS of them a text, which is what the driver gets.

Defined results: null text, or text without any letter, is `und` with score 0; without training rows all is `und`; with a
single language every text with a letter is of it; null ids are ids like others and are never held out; repeated rows each
get their row; further columns may have any name; empty tables give no rows; very long texts are read whole.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, lower_ascii, materialize, release, to_bytes

#: Labelled rows per language used at most, and of all languages together (one at least of each language): the bounds of
#: the training sample.
PER_LANGUAGE = 400
SAMPLE_ROWS = 8000
#: The model's n-grams: those that the most texts of the sample have, and so many texts at least.
GRAMS, LEAST_TEXTS = 5000, 3
BITS = 16
_TURN = 1 << 40
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # 2**BITS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int) -> np.ndarray:
    """n distinct codewords: all splits of the languages for few, else random ones kept far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if i == 0 or (s >> (i - 1)) & 1 else -1 for s in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8)
    bits = int(10 * np.ceil(np.log2(n)))
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code[0, (code == code[0]).all(axis=0)] *= -1  # every bit tells some languages apart
        apart = min((bits - int(a) for row in code[:64] for a in np.sort(code.astype(int) @ row.astype(int))[-2:-1]), default=bits)
        if apart > far:
            best, far = code, apart
    return best


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams and 2-grams of all texts (framed by blanks), and where each text begins."""
    raw = np.frombuffer(b"".join(b" " + t + b"  " for t in texts), np.uint8).astype(np.uint32)
    pair = raw[:-2] * np.uint32(2654435761) + raw[1:-1] * np.uint32(2246822519)
    triple = (pair + raw[2:] * np.uint32(3266489917)) ^ np.uint32(0x5BD1E995)
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    return np.stack([fold(triple), fold(pair)]), starts


def margins(model: Model, texts: list[bytes]) -> np.ndarray:
    """texts x bits."""
    if not texts:
        return np.zeros((0, len(model.bias)))
    h, starts = grams(texts)
    ends = np.append(starts[1:], h.shape[1] + 2)
    total = np.zeros((len(texts), len(model.bias)))
    step = 1 << 19
    for i in range(0, h.shape[1], step):  # in steps, so that a long text needs little memory
        part = h[:, i : i + step]
        inside = np.flatnonzero((starts < i + part.shape[1]) & (ends > i))
        cuts = np.maximum(starts[inside], i) - i
        keep = cuts < part.shape[1]
        for row in part:
            total[inside[keep]] += np.add.reduceat(model.weights[row], cuts[keep], axis=0)
    n = np.maximum(ends - starts - 2, 1)
    return total / (2 * n[:, None]) + model.bias


def profile(text: object) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Distinct hashed n-grams of a text, their counts and the counts' sum; None without a letter."""
    if not isinstance(text, str) or not _LETTER.search(text):
        return None
    keys, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h, _ = grams([lower_ascii(to_bytes(text))])
    for i in range(0, h.shape[1], 1 << 20):
        k, m = np.unique(h[:, i : i + (1 << 20)], return_counts=True)
        keys, of = np.unique(np.concatenate([keys, k]), return_inverse=True)
        n = np.bincount(of, np.concatenate([n, m])).astype(np.int64)
    return keys, n, int(n.sum())


def widest(share: np.ndarray, texts: int) -> np.ndarray:
    """The model's n-grams, in order, from how many texts have each."""
    used = np.flatnonzero(share >= min(LEAST_TEXTS, texts))
    return np.sort(used[np.argsort(-share[used], kind="stable")[:GRAMS]])


def _matrix(found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram shares of each text, for the model's n-grams, and which those are."""
    used = widest(np.bincount(np.concatenate([k for k, *_ in found]), minlength=2**BITS), len(found))
    out = np.zeros((len(found), len(used)), np.float32)
    for i, (k, n, total) in enumerate(found):
        hit = np.isin(k, used, assume_unique=True)
        out[i, np.searchsorted(used, k[hit])] = n[hit] / max(total, 1)
    return out, used


def fit(rows: list[tuple[tuple[np.ndarray, np.ndarray, int], str]], rounds: int = 150, reg: float = 1e-6) -> Model | None:
    """rows: (profile of a text, language), few by contract. Every fifth row is set aside for the bits' weights."""
    rows = [(t, g) for t, g in rows if t is not None and g is not None]
    languages = sorted({g for _, g in rows})
    if not languages:
        return None
    code = codewords(len(languages)).astype(np.float32)
    place = {g: i for i, g in enumerate(languages)}
    x, used = _matrix([t for t, _ in rows])
    y = np.array([place[g] for _, g in rows])
    scale = 1 / np.sqrt((x**2).mean(axis=0) + 1e-10)
    x *= scale
    share = np.bincount(y, minlength=len(languages))
    weight = (1 / share[y]).astype(np.float32)
    weight /= weight.sum()
    goal = code[y]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    xt, gt, wt = x[~held], goal[~held], weight[~held, None]
    rate = 4.0 / max(1e-6, float((xt**2).sum(axis=1).mean()))
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        slope = -gt * wt / (1 + np.exp(np.clip(gt * (xt @ w + b), -30, 30)))
        vw = 0.9 * vw - rate * (xt.T @ slope + reg * w)
        vb = 0.9 * vb - rate * slope.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x[held] @ w + b) * goal[held] > 0).mean(axis=0) if held.any() else np.ones(len(b))
    full = np.zeros((2**BITS, code.shape[1]), np.float32)
    full[used] = w * scale[:, None]
    return Model(languages, code, full, b, np.clip(2 * right - 1, 0.05, 1.0))


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share (0 to 1) and how far the next one is behind."""
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]) @ model.trust
    chance = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    two = np.sort(chance, axis=1)[:, -2:] if chance.shape[1] > 1 else np.stack([np.zeros(len(best)), chance[:, 0]], axis=1)
    return best, chance[np.arange(len(best)), best], two[:, 1] - two[:, 0]


def held_out(id_col):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most per_language rows of each language among those not held out; every labelled row is a candidate.

    Per language these are the rows of the smallest hashes of id and text. A threshold that leaves about twice as many
    comes first, so that a language with most of the rows is no large group.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    rows = rows.withColumn("pick", F.pmod(F.xxhash64(F.lit("train"), F.col("id").isNull(), "id", "text"), F.lit(_TURN)))
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    found = counts.count()
    if not found:
        return None
    most = max(1, min(per_language, SAMPLE_ROWS // found))
    near = rows.join(few(counts), "lang").filter(F.col("pick").cast("double") * F.col("n") <= 2.0 * (most + 20) * _TURN)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "id", "text"))
    best = near.withColumn("place", place).filter(F.col("place") <= most).select("pick", "text", "lang")

    def count(batches):
        for batch in batches:
            got = [(p, g, profile(t)) for p, g, t in zip(*(batch.column(c).to_pylist() for c in ("pick", "lang", "text")))]
            yield _profiles([(p, g, *x) for p, g, x in got if x is not None])

    def tally(batches):
        share = np.zeros(2**BITS, np.int64)
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                share[np.frombuffer(keys, np.uint32)] += 1
        at = np.flatnonzero(share)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(share[at])], ["gram", "n"])

    # what comes to the driver is the model's n-grams of a bounded number of texts
    sample = materialize(best.mapInArrow(count, _PROFILE), "language-sample")
    share = np.zeros(2**BITS, np.int64)
    for r in sample.select("keys").mapInArrow(tally, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        share[r["gram"]] = r["n"]
    used = widest(share, sample.count())

    def narrowed(batches):
        for batch in batches:
            rows = []
            for p, g, keys, n, total in zip(*(batch.column(c).to_pylist() for c in ("pick", "lang", "keys", "n", "total"))):
                k, n = np.frombuffer(keys, np.uint32), np.frombuffer(n, np.uint32)
                hit = np.isin(k, used, assume_unique=True)
                rows.append((p, g, k[hit], n[hit], total))
            yield _profiles(rows)

    got = sorted(sample.mapInArrow(narrowed, _PROFILE).collect(), key=lambda r: (r["pick"], r["lang"], r["keys"]))
    return fit([((np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["n"], np.uint32), r["total"]), r["lang"]) for r in got])


_PROFILE = "pick long, lang string, keys binary, n binary, total long"


def _profiles(rows: list[tuple]) -> pa.RecordBatch:
    cells = lambda j: pa.array([r[j].astype(np.uint32).tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), cells(2), cells(3), pa.array([r[4] for r in rows], pa.int64())], ["pick", "lang", "keys", "n", "total"])


def predict(model: Model | None, texts: list, ambiguous: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous for each text."""
    ok = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)] if model else []
    lang, score, doubt = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i in range(0, len(ok), 256):
        part = ok[i : i + 256]
        best, share, ahead = decode(model, margins(model, [lower_ascii(to_bytes(texts[j])) for j in part]))
        lang[part] = [model.languages[b] for b in best]
        score[part], doubt[part] = share, ahead < ambiguous
    return lang, score, doubt


def identify(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = 0.1) -> DataFrame:
    """One row per document: id, lang_pred, score, ambiguous."""
    spark, kind = documents.sparkSession, documents.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # 2**BITS x bits floats, whatever the input's size

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in batches:
            found = predict(m, batch.column("text").to_pylist(), ambiguous)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.float64(), pa.bool_())))], ["id", "lang_pred", "score", "ambiguous"])
        release()

    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def keep_identified(documents: DataFrame, model: Model | None, text_col: str = "text", ambiguous: float = 0.1, least: float = 0.5) -> DataFrame:
    """The documents with a language, ambiguous ones only from a score of `least` on; each row is judged by its own text."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in batches:
            lang, score, doubt = predict(m, batch.column(text_col).to_pylist(), ambiguous)
            yield batch.filter(pa.array((lang != "und") & ~(doubt & (score < least))))
        release()

    return documents.mapInArrow(run, documents.schema)
