"""Language identification with string kernels.

The kernel of two texts is the normalised count of byte n-grams (one to three
bytes, hashed, A-Z lower-cased) present in both: a blended spectrum of
presences.  Nystrom landmarks turn it into finite features, on which one
ridge regression a language is solved against the rest.  Scoring multiplies
batches of presence rows by the landmarks and the result by the weights.

A presence row is kept as one bit a bin until it is multiplied, so the fit's one
task holds at most ``langs`` x ``per_lang`` x ``bins`` bits of rows and
``landmarks`` dense rows, and the model that is broadcast is a bit a bin of each
landmark, however large the corpus and its texts are.

Defined results: ``und`` with score 0 for texts that are null or without a
letter, and for all where no language was learned; ties go to the first
language in code point order.  Repeated rows are learned once; rows of null id
or language teach nothing; an id's several texts each count; an empty table
gives no rows.  Columns ``lang_pred``, ``lang_score`` and ``_lang`` of the
input are replaced or left out; all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneweave.llm import textkernel as tk
from cloneweave.llm.common import sample_per_class

UND = "und"


@dataclass(frozen=True)
class LangParams:
    """``per_lang`` bounds the rows of each language that are fitted, ``langs`` the languages (the most frequent), ``landmarks`` all their landmarks."""

    bins: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    landmarks_per_lang: int = 16
    landmarks: int = 512
    langs: int = 200
    per_lang: int = 300
    ridge: float = 1e-3
    sharpness: float = 6.0
    block: int = 64  # presence rows that are dense at a time


def presence(texts: pa.Array, p: LangParams):
    """(first row, rows of 0 and 1) in blocks; whole texts."""
    mask = np.uint32(p.bins - 1)
    body, at = tk.flat(texts)
    for row in range(0, len(at) - 1, p.block):
        to = min(row + p.block, len(at) - 1)
        out = np.zeros((to - row, p.bins), dtype=np.float32)
        for i in range(row, to):
            b = tk.LOWER[body[at[i] : at[i + 1]]].astype(np.uint32)
            for n in p.orders:
                if len(b) >= n:
                    g = np.full(len(b) - n + 1, n, dtype=np.uint32)
                    for j in range(n):
                        g = g * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j]
                    g ^= g >> np.uint32(15)
                    g *= np.uint32(0x2C1B3C6D)
                    g ^= g >> np.uint32(13)
                    out[i - row, g & mask] = 1
        yield row, out


def normal(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, so that a product of two is the kernel."""
    rows = rows.astype(np.float32, copy=False)
    rows /= np.maximum(np.sqrt(rows.sum(1)), 1)[:, None]
    return rows


def unpacked(bits: np.ndarray) -> np.ndarray:
    return normal(np.unpackbits(bits, axis=1))


def solve(bits: np.ndarray, langs: list[str], p: LangParams) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, landmarks (m rows of bits) and weights (m + 1 x languages) of presence rows as bits."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    each = max(1, min(p.landmarks_per_lang, p.landmarks // len(names)))
    marks = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    base = unpacked(bits[marks])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    weight = (1 / np.bincount(y, minlength=len(names)))[y] * len(y) / len(names)
    size = root.shape[1] + 1
    left, right = np.zeros((size, size)), np.zeros((size, len(names)))
    for i in range(0, len(y), p.block):
        phi = (unpacked(bits[i : i + p.block]) @ base.T).astype(np.float64) @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        weighted = phi * weight[i : i + p.block, None]
        left += weighted.T @ phi
        right += weighted.T @ np.where(y[i : i + p.block, None] == np.arange(len(names)), 1.0, -1.0)
    left += p.ridge * len(y) * np.diag([1.0] * (size - 1) + [0.0]) + 1e-9 * np.eye(size)
    beta = np.linalg.solve(left, right)
    return names, bits[marks], np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LangParams | None = None):
    """Learn from at most ``per_lang`` rows of each language that have a text; one task fits that sample."""
    p = params or LangParams()
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null and _id is not null and _text rlike '\\\\p{L}'")
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    key = ["_id", "_h", "_lang"]
    picked = sample_per_class(rows.select(*key), ["_id", "_h"], "_lang", p.per_lang, labels=p.langs)
    kind = dict(rows.dtypes)["_id"]

    def extract(batches):
        for b in batches:
            bits = [r.tobytes() for _, x in presence(b.column("_text"), p) for r in np.packbits(x > 0, axis=1)]
            yield pa.record_batch([*(b.column(c) for c in key), pa.array(bits, pa.binary())], [*key, "bits"])

    def learn(batches):
        read = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in key), b["bits"].to_pylist()))
        read = [read[i] for i in np.random.default_rng(3).permutation(len(read))]
        if read:
            names, base, weights = solve(np.frombuffer(b"".join(r[3] for r in read), np.uint8).reshape(len(read), -1), [r[2] for r in read], p)
            yield pa.record_batch([pa.array([names]), pa.array([base.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], ["names", "base", "weights"])

    found = rows.join(F.broadcast(picked), key).select(*key, "_text").mapInArrow(extract, f"_id {kind}, _h long, _lang string, bits binary").dropDuplicates(key)
    got = found.repartition(1).mapInArrow(learn, "names array<string>, base binary, weights binary").collect()
    if not got:
        return [], np.zeros((0, p.bins // 8), np.uint8), np.zeros((1, 0), np.float32)
    names = list(got[0]["names"])
    weights = np.frombuffer(got[0]["weights"], np.float32).reshape(-1, len(names))
    return names, np.frombuffer(got[0]["base"], np.uint8).reshape(-1, p.bins // 8), weights


def predict(texts: pa.Array, lettered: np.ndarray, model, p: LangParams) -> tuple[list[str], np.ndarray]:
    """Languages and scores; ``model`` is (languages, dense landmarks (bins x m), weights)."""
    names, base, weights = model
    langs, scores = [UND] * len(texts), np.zeros(len(texts))
    if not names:
        return langs, scores
    for row, x in presence(texts, p):
        margin = (normal(x) @ base) @ weights[:-1] + weights[-1]
        e = np.exp(p.sharpness * (margin - margin.max(1, keepdims=True)).astype(np.float64))
        best = margin.argmax(1)
        top = e[np.arange(len(e)), best] / e.sum(1)
        for i in range(len(x)):
            if lettered[row + i]:
                langs[row + i], scores[row + i] = names[best[i]], top[i]
    return langs, scores


def identify(documents: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", params: LangParams | None = None) -> DataFrame:
    """All columns of ``documents`` with lang_pred and lang_score beside them, in place of columns of these names."""
    p = params or LangParams()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bits of bins x landmarks, whatever the input
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    dense: list[tuple] = []  # once a task

    @F.arrow_udf(kind)
    def found(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        if not dense:
            names, bits, weights = shared.value
            dense.append((names, unpacked(bits).T.copy(), weights))
        langs, scores = predict(texts, lettered.to_numpy(zero_copy_only=False), dense[0], p)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    # only the text goes to Python; the other columns stay in the JVM
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = documents.drop("lang_pred", "lang_score", "_lang").withColumn("_lang", found(F.col(text_col), lettered))
    return rows.withColumns({"lang_pred": F.col("_lang.lang"), "lang_score": F.col("_lang.score")}).drop("_lang")
