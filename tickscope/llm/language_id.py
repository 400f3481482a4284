"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by multiplying its letters' vectors, the first
permuted twice, the second once (a rotation by one place). A text's vector bundles (adds) its trigrams, a language's
prototype bundles the trigrams of all its training texts; texts are compared with prototypes by cosine.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no language was learned;
on a tie the language that sorts first wins. Rows with a null language are not learned from. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.arrow import with_columns

SYMBOLS = 64  # 0 is the space between words, 1 to 26 are a to z, other letters share the rest by code point
DIMENSIONS = 1024
CODES = SYMBOLS**3
#: Trigrams whose vectors exist at one time, and characters of a batch of texts: bounds of a task's memory.
VECTORS_AT_ONCE = 8192
CHARS_AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _symbol_of() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(4).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    base = _letters()
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return (np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams of the lower-cased text, white space and other signs between words being one space."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    s = _symbol_of()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not s.any():
        return np.zeros(0, dtype=np.int64)
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
    if s[-1] != 0:
        s = np.append(s, 0)
    return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each text's distinct trigrams."""
    codes = [trigrams(t) for t in texts]
    rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    keys = rows * CODES + (np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64))
    keys, n = np.unique(keys, return_counts=True)
    return keys // CODES, keys % CODES, n


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One vector and the number of trigrams per text."""
    rows, codes, n = _counted(texts)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    used, place = np.unique(codes, return_inverse=True)
    for at in range(0, len(used), VECTORS_AT_ONCE):
        vectors = trigram_vectors(used[at:at + VECTORS_AT_ONCE])
        mine = (place >= at) & (place < at + VECTORS_AT_ONCE)
        counts = np.zeros((len(texts), len(vectors)), dtype=np.float32)
        counts[rows[mine], place[mine] - at] = n[mine]
        out += counts @ vectors
    return out.astype(np.float64), np.bincount(rows, weights=n, minlength=len(texts)).astype(np.int64)


def _in_parts(texts, most: int = 256) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        if part and (chars + len(t or "") > CHARS_AT_ONCE or len(part) == most):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


def learn(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes, from every row with a language.

    Each task adds up trigrams by language; the table of counts has at most 262,144 rows per language, and one vector per
    language comes to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            parts = [(lang, np.flatnonzero(s), s[np.flatnonzero(s)]) for lang, s in sums.items()]
            sums.clear()
            return pd.DataFrame({"lang": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(object),
                                 "code": np.concatenate([p[1] for p in parts]), "n": np.concatenate([p[2] for p in parts])})

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                s = sums.setdefault(lang, np.zeros(CODES, dtype=np.int64))
                for part in _in_parts(texts):
                    for t in part:
                        s += np.bincount(trigrams(t), minlength=CODES) if len(t or "") > CODES else 0
                    _, codes, n = _counted([t for t in part if len(t or "") <= CODES])
                    s += np.bincount(codes, weights=n, minlength=CODES).astype(np.int64)
                if len(sums) == 64:
                    yield flush()
        if sums:
            yield flush()

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DIMENSIONS)
        pdf = pdf.sort_values("code")
        for at in range(0, len(pdf), VECTORS_AT_ONCE):
            part = pdf.iloc[at:at + VECTORS_AT_ONCE]
            total += part["n"].to_numpy(np.float64) @ trigram_vectors(part["code"].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "vector": [total.tolist()]})

    seen = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = seen.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = sorted(((r["lang"], r["vector"]) for r in counts.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").collect()))
    vectors = np.array([v for _, v in found]).reshape(len(found), DIMENSIONS)
    return [lang for lang, _ in found], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, text_col: str, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` and ``n_trigrams``; only the text is looked at."""

    def run(texts: list[str | None]) -> list[list]:
        best, score, size = [], [], []
        for part in _in_parts(texts):
            v, n = bundles(part)
            cosines = v @ prototypes.T / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            for c, k in zip(cosines, n):
                at = int(c.argmax()) if k and len(c) else None
                best.append("und" if at is None else languages[at])
                score.append(0.0 if at is None else float(np.clip(c[at], 0, 1)))
                size.append(int(k))
        return [best, score, size]

    return with_columns(docs, text_col, {"lang_pred": "string", "score": "double", "n_trigrams": "long"}, run)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, learned from the rows that are not held out. Two passes, no shuffle of texts."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.withColumn("held_out", held_out(F.col("doc_id")))
    languages, prototypes = learn(own.where(~F.col("held_out")), "text", "lang")
    return predict(own.select("doc_id", "held_out", "text"), "text", languages, prototypes).drop("text", "n_trigrams")
