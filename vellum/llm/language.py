"""Language identification with string kernels.

A text is the set of its character n-grams of length 1 to 3 (a blended spectrum,
present or absent).  The kernel of two texts is the size of the common set over the geometric mean
of the sizes.  Landmark texts give a Nystrom approximation of the kernel, in which
one ridge regression per language is solved; texts are scored in batches, as the product
of their presence matrix with the landmarks' and then with the regressions' matrix.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from string import ascii_letters as ASCII_LETTERS

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, held_out, unused
from .textvec import mix

ship(__name__)

#: Training texts of a language and of all at most (the first in the order of a hash), landmarks, and the ridge.
PER_LANGUAGE, TRAIN_ROWS, LANDMARKS, RIDGE = 300, 12_000, 240, 0.05
FOLDS, FOLD = 5, 0
#: Numbers that n-grams are hashed to, a power of 2; with a bit for each, a training text takes 32 KB at most.
SPACE_BITS = 18
SPACE = 1 << SPACE_BITS
#: Texts of a batch, training texts put into a matrix at a time, and characters looked at together.
BATCH, ROWS, SLICE = 64, 256, 1 << 20
#: Divides the regressions' outputs before they become shares of 1.
TEMPERATURE = 0.25
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))  # the class also holds figures such as a raised 2


_scripts: dict[int, str] = {}


def script(code: int) -> str:
    """The script of a letter, which its name in the Unicode tables begins with."""
    if code not in _scripts:
        _scripts[code] = unicodedata.name(chr(code), "").partition(" ")[0]
    return _scripts[code]


def scripts(text: str) -> dict[str, int]:
    """How many letters of each script a text has."""
    if text.isascii():
        return {"LATIN": sum(map(text.count, ASCII_LETTERS))}
    out: dict[str, int] = {}
    for at in range(0, len(text), SLICE):
        codes, n = np.unique(np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "replace"), np.uint32), return_counts=True)
        for code, times in zip(codes[letters()[codes]].tolist(), n[letters()[codes]].tolist()):
            out[script(code)] = out.get(script(code), 0) + times
    return out


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def symbols(text: str) -> np.ndarray:
    """The code points of the letters in lower case; a run of anything else is one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.where(letters()[codes], codes, 0).astype(np.uint64)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def mark(text: str, row: np.ndarray) -> None:
    """Sets the entries of the n-grams of `text`, however long it is."""
    shift = np.uint64(64 - SPACE_BITS)
    for at in range(0, max(len(text), 1), SLICE):
        s = symbols(" " + text[max(0, at - 2) : at + SLICE] + " ")
        pairs = s[:-1] << np.uint64(21) | s[1:]
        for n, grams in enumerate((s, pairs, pairs[:-1] << np.uint64(21) | s[2:]), 1):
            row[mix(mix(np.array([n], np.uint64)) + grams) >> shift] = True


@dataclass
class StringKernel:
    """vocabulary: the landmarks' n-grams; landmarks: their presence, scaled; weights: landmarks by languages; scripts: those of the training texts."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    scripts: frozenset[str] = field(default=frozenset())

    @classmethod
    def fit(cls, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> StringKernel:
        languages = sorted(set(langs))
        chosen = list(range(min(landmarks, len(sets))))
        vocabulary = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        root = np.sqrt(np.maximum([len(s) for s in sets], 1)).astype(np.float32)

        def presence(lo: int, hi: int) -> np.ndarray:
            out = np.zeros((hi - lo, len(vocabulary)), np.float32)
            for i, s in enumerate(sets[lo:hi]):
                out[i, np.searchsorted(vocabulary, s[np.isin(s, vocabulary, assume_unique=True)])] = 1
            return out / root[lo:hi, None]

        marks = presence(0, len(chosen))
        kernel = np.concatenate([presence(lo, min(lo + ROWS, len(sets))) @ marks.T for lo in range(0, len(sets), ROWS)])
        values, vectors = np.linalg.eigh(kernel[: len(chosen)].astype(float))
        half = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = kernel @ half
        target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        solved = np.linalg.solve(features.T @ features + ridge * np.eye(half.shape[1]), features.T @ target)
        return cls(languages, vocabulary, marks, (half @ solved).astype(np.float32))

    def known_share(self, text: str) -> float:
        """The share of a text's letters that are of a script that some training text has."""
        found = scripts(text)
        return sum(n for s, n in found.items() if s in self.scripts) / max(sum(found.values()), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        """Shares of 1 for each text and language."""
        rows = np.zeros((len(texts), SPACE), bool)
        for row, text in zip(rows, texts):
            mark(text, row)
        size = np.maximum(rows.sum(axis=1), 1)
        seen = rows[:, self.vocabulary]
        kernel = (seen.astype(np.float32) @ self.landmarks.T) / np.sqrt(size)[:, None]
        out = (kernel @ self.weights) / TEMPERATURE
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def decoded(value: pa.Scalar) -> str | None:
    raw = value.as_py()
    return None if raw is None else raw.decode("utf-8", "replace")


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, train_rows: int = TRAIN_ROWS, folds: int = FOLDS, fold: int = FOLD) -> StringKernel | None:
    """Fits on rows outside `fold` with a language and a letter; None where there are none.

    The first `per_language` rows of each language are taken, in the order of a hash, and of these the `train_rows` first in
    turn of the languages, so the landmarks, which come first, are even by language.
    """
    docs = docs.select("doc_id", "text", "lang")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ranked = known.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")).alias("_place"))
    chosen = ranked.where(F.col("_place") <= per_language).orderBy("_place", "_lang").limit(train_rows).groupBy("_id", "_lang").agg(F.min("_place").alias("_place"))
    texts = known.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("_id", "_lang", "_place", "text")

    def run(batches):
        row = np.zeros(SPACE, bool)
        for batch in batches:
            sets, kinds = [], []
            for value in batch.column(3).cast(pa.binary()):
                text = decoded(value)
                row[:] = False
                if has_letter(text):
                    mark(text, row)
                sets.append(np.packbits(row).tobytes() if row.any() else None)
                kinds.append(sorted(scripts(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "lang", "place", "grams", "scripts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Of rows that share a doc_id and language the one with the least n-grams by their bits counts, so reruns agree.
    got = arrow_map(texts, run, f"id {kind}, lang string, place int, grams binary, scripts array<string>").where("grams is not null").groupBy("id", "lang").agg(
        F.min("place").alias("place"), F.min("grams").alias("grams"), F.array_distinct(F.flatten(F.collect_list("scripts"))).alias("scripts")).toArrow()
    if not got.num_rows:
        return None
    unpacked = (np.flatnonzero(np.unpackbits(np.frombuffer(g.as_buffer(), np.uint8))).astype(np.int32) for g in got.column("grams"))
    rows = sorted(zip(got.column("place").to_pylist(), got.column("lang").to_pylist(), unpacked), key=lambda r: r[:2])
    model = StringKernel.fit([r[2] for r in rows], [r[1] for r in rows])
    model.scripts = frozenset(s for own in got.column("scripts").to_pylist() for s in own)
    return model


def identify(docs: DataFrame, model: StringKernel | None, pred_name: str = "lang_pred", score_name: str = "score", known_name: str = "known_share") -> DataFrame:
    """`docs` with lang_pred, score and known_share, the share of the letters that are of a script of the training texts (columns of these names are replaced).

    `und`, 0 and 0 for a text that is null or has no letter, or without a model; long texts are read whole.
    """
    added = (pred_name, score_name, known_name)
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names)
    place = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [decoded(v) for v in batch.column(place).cast(pa.binary())]
            pred, score, share = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            for at in range(0, len(known), BATCH):
                part = known[at : at + BATCH]
                shares = model.score([texts[i] for i in part])
                best = shares.argmax(axis=1)
                for i, b, s in zip(part, best, shares[np.arange(len(part)), best]):
                    pred[i], score[i], share[i] = model.languages[b], s, model.known_share(texts[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(share)], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, `{pred_name}` string, `{score_name}` double, `{known_name}` double")


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text has a letter, which are those that identify() names a language for if it has a model."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = (decoded(v) for v in batch.column(place).cast(pa.binary()))
            yield batch.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


#: Share of a text's letters that must be of a script of the training texts.  A language that was learned is written as they are, however many characters
#: it has and however few of its n-grams the landmarks hold.
LEAST_KNOWN = 0.5


def in_known_languages(docs: DataFrame, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang and other columns) whose text is in a language that the model tells.

    Texts that are null, empty or without a letter are rejected, and those of whose letters less than `least_known` are of a
    script that some training row has.  Where no row can train a model, all texts with a letter stay.
    Long texts are read whole, repeated rows judged alike, columns of any name kept; an empty table gives an empty one.
    """
    model = fit_languages(docs)
    if model is None:
        return with_letters(docs)
    pred, score, known = unused(docs, "lang_pred", "lang_score", "known_share")
    found = identify(docs, model, pred, score, known)
    return found.where((F.col(pred) != "und") & (F.col(known) >= least_known)).select(*docs.columns)


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    lang is read for the fit alone.  A text that is null or empty or has no letter is `und`, score 0.  Repeated rows are scored each, equal scores go to
    the first language by name, whole texts are read, however long, other columns are not, and an empty table gives an empty one.
    Without a row to learn from there is no language to name, so all are `und`.
    """
    model = fit_languages(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
