"""Toxicity: a support vector machine over a gapped subsequence kernel with Nystrom landmarks.

A sentence is a set of words, each the row of its letters.  The kernel of two words counts their common subsequences of three
letters, each occurrence weighted by a factor for every letter that it spans, so that gaps and inserted letters make words less alike, not unlike; it is
scaled to 1 for equal words.  Landmark words give a Nystrom approximation, in which a linear machine with squared hinge loss is trained.  Labels are of
documents, not of sentences: in a toxic document the sentence with the strongest word is the toxic one (found anew in every
round, with the machine so far), in a clean one every sentence is clean.  A document has the score of its strongest sentence.

The machine is a sum over landmarks, the kernel a sum over subsequences; summed over the landmarks first, it is a table with a
weight for each subsequence, by which any word is scored.  A worker remembers the scores of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, held_out

ship(__name__)

#: Labelled rows of either kind that a fit uses at most, and distinct words of each: the first in the order of a hash.
TOXIC_ROWS, CLEAN_ROWS, ROW_WORDS = 2_500, 5_000, 2_000
#: Landmarks, rounds of choosing the toxic sentences, clean words of a round, and the weight of errors.
LANDMARKS, ROUNDS, CLEAN, COST = 320, 4, 6_000, 3.0
#: How many times more frequent in toxic documents than in clean ones a word must be to be what makes them toxic.
PURITY = 4
#: Letters that a subsequence spans at most, and the factor for each of them.
SPAN, DECAY = 5, 0.6
#: Bits of a letter's number; 0 is none.
BITS = 6
TRIPLES = 1 << (3 * BITS)
#: Characters for the beginning and the end of a word, which are letters of the kernel, and the numbers of these.
BEGIN, END = "\1", "\2"
LETTERS = np.array([0, 62, 63, 0])
#: Longer words are looked at in windows of so many letters, each beginning half a window after the one before.
WINDOW = 24
#: Words scored at a time, words of a matrix, and words remembered by a worker.
AT_ONCE, ROWS, REMEMBERED = 10_000, 512, 300_000
SPLIT = re.compile(r"\s+")
#: Lone letters with anything but letters and figures between them are one word too.
LONE = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W_]{1,3}[^\W\d_](?![^\W\d_])){2,}")
FOLDS, FOLD, TOXIC = 5, 0, 0.5


def words(text: str) -> set[str]:
    """The distinct words of a text in lower case: the letters between two spaces, and runs of lone letters."""
    text = text.lower()
    found = {w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in set(text.split())}
    found.update("".join(filter(str.isalpha, run)) for run in LONE.findall(text))
    found.discard("")
    return found


def numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words as numbers, a beginning and an end around each word, zeros after it (or after a window of a long one); whose window each is, and each window's word."""
    if any(len(w) + 2 > WINDOW for w in words):
        cut = [(i, w[at : at + WINDOW]) for i, w in enumerate(BEGIN + w + END for w in words) for at in range(0, max(len(w) - WINDOW // 2, 1), WINDOW // 2)]
    else:
        cut = [(i, BEGIN + w + END) for i, w in enumerate(words)]
    gap = "\0" * SPAN
    codes = np.frombuffer((gap.join(w for _, w in cut) + gap).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    plain = (codes >= 97) & (codes <= 122)
    letters = np.where(plain, codes - 96, np.where(codes < 3, LETTERS[np.minimum(codes, 3)], 27 + codes * 2654435761 % (1 << 32) % 35))
    return letters, np.repeat(np.arange(len(cut)), [len(w) + SPAN for _, w in cut]), np.array([i for i, _ in cut], np.int64)


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences of all windows of `words`: window and subsequence, once each, and weight; and each window's word."""
    letters, of, owner = numbers(words)
    keys, weights = [], []
    padded = np.concatenate([letters, np.zeros(SPAN, np.int64)])
    n = len(letters)
    for last in range(2, SPAN):
        for mid in range(1, last):
            a, b, c = letters, padded[mid : mid + n], padded[last : last + n]
            # A zero between the first and the last is the end of the word, as those are as many as the span.
            at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            keys.append(of[at] << (3 * BITS) | a[at] << (2 * BITS) | b[at] << BITS | c[at])
            weights.append(np.full(len(at), DECAY ** (last + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> (3 * BITS), key[first] & (TRIPLES - 1), np.add.reduceat(weight, first) if len(key) else weight, owner


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, subsequence and weight for words of one window each, scaled so that the kernel of a word with itself is 1."""
    word, triple, weight, _ = entries([w[: WINDOW - 2] for w in words])
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, triple, weight / norm[word]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Words by landmarks."""
    mark, triple, weight = features(landmarks)
    known = np.unique(triple)
    dense = np.zeros((len(known), len(landmarks)))
    dense[np.searchsorted(known, triple), mark] = weight
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), ROWS):
        word, triple, weight = features(words[lo : lo + ROWS])
        at = np.searchsorted(known, triple)
        there = known[np.minimum(at, len(known) - 1)] == triple if len(known) else np.zeros(len(at), bool)
        own = np.zeros((len(words[lo : lo + ROWS]), len(known)))
        own[word[there], at[there]] = weight[there]
        out[lo : lo + ROWS] = own @ dense
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of a linear machine with squared hinge loss: Newton steps, each over the rows within the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([*np.ones(x.shape[1] - 1), 1e-3])
    w, before = np.zeros(x.shape[1]), None
    for _ in range(40):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        own = x[inside] * cost[inside, None]
        w, before = np.linalg.solve(ridge + 2 * own.T @ x[inside], 2 * own.T @ y[inside]), inside
    return w


@dataclass
class Machine:
    """table: a weight for each subsequence; bias; slope and shift of the logistic function that makes a score of it."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def of_words(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word; a word of fewer than three letters has the bias alone."""
        out = np.full(len(words), -np.inf)
        for lo in range(0, len(words), AT_ONCE):
            window, triple, weight, owner = entries(words[lo : lo + AT_ONCE])
            norm = np.sqrt(np.maximum(np.bincount(window, weight**2, len(owner)), 1e-12))
            value = np.bincount(window, weight * self.table[triple], len(owner)) / norm + self.bias
            np.maximum.at(out, owner + lo, value)
        return out

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500))))


def fit(bags: list[np.ndarray], toxic: np.ndarray, names: list[str]) -> Machine | None:
    """From the words of documents, as numbers in `names`, and whether each is toxic; None without a word of either kind."""
    used = np.array([len(bag) > 0 for bag in bags], bool)
    bags, toxic = [bag for bag in bags if len(bag)], np.asarray(toxic, bool)[used] if len(bags) else np.zeros(0, bool)
    if toxic.all() or not toxic.any():
        return None
    sizes = toxic.sum(), (~toxic).sum()
    counts = np.stack([np.bincount(np.concatenate([bag for bag, t in zip(bags, toxic) if t == kind]), minlength=len(names)) for kind in (True, False)], axis=1).astype(float)
    # Before there is a machine, a word is as toxic as the documents that it stands in, and its subsequences as their words.
    excess = np.log((counts[:, 0] + 0.1) / (sizes[0] + 1)) - np.log((counts[:, 1] + 0.1) / (sizes[1] + 1))
    often = np.minimum(counts, 5)
    share, value = np.zeros((2, TRIPLES)), np.zeros(len(names))
    for lo in range(0, len(names), AT_ONCE):
        word, triple, weight = features(names[lo : lo + AT_ONCE])
        for side in (0, 1):
            share[side] += np.bincount(triple, often[lo + word, side] * weight, TRIPLES)
    share /= np.maximum(often.sum(axis=0), 1)[:, None]
    tilt = np.log((share[0] + 1e-5) / (share[1] + 1e-5))
    for lo in range(0, len(names), AT_ONCE):
        word, triple, weight = features(names[lo : lo + AT_ONCE])
        n = len(names[lo : lo + AT_ONCE])
        value[lo : lo + n] = np.bincount(word, weight * tilt[triple], n) / np.maximum(np.bincount(word, weight, n), 1e-9)
    value += excess
    # Labels err: a word that clean documents use as well can't be what makes one toxic, and a document of such words alone teaches nothing.
    telling = counts[:, 0] * sizes[1] >= PURITY * counts[:, 1] * sizes[0]
    leads = [own for own in (bag[telling[bag]] for bag, t in zip(bags, toxic) if t) if len(own)]
    if not leads:
        return None
    others = np.flatnonzero(counts[:, 1] > 0)
    mixed = np.random.default_rng(7).permutation(others)
    for _ in range(ROUNDS):
        chosen, often = np.unique([own[np.argmax(value[own])] for own in leads], return_counts=True)
        hard = others[np.argsort(-value[others], kind="stable")[: CLEAN // 2]]
        against = np.unique(np.concatenate([hard, mixed[: CLEAN // 2]]))
        lead = chosen[np.argsort(-often, kind="stable")][: LANDMARKS // 2]
        marks = [names[i] for i in dict.fromkeys([*lead.tolist(), *hard[: LANDMARKS // 4].tolist(), *mixed[: LANDMARKS // 4].tolist()])]
        rows = [names[i] for i in [*chosen, *against]]
        y = np.repeat([1.0, -1.0], [len(chosen), len(against)])
        cost = np.concatenate([often / often.sum(), np.full(len(against), 1 / len(against))]) * COST * len(rows) / 2
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
        half = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        w = machine(kernel(rows, marks) @ half, y, cost)
        mark, triple, weight = features(marks)
        model = Machine(np.bincount(triple, weight * (half @ w[:-1])[mark], TRIPLES), float(w[-1]))
        value = model.of_words(names)
    model.slope, model.shift = logistic(np.array([value[bag].max() for bag in bags]), toxic.astype(float))
    return model


def usable(bag: Iterable[str]) -> set[str]:
    return {w for w in bag if len(w) > 2}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic function, with a small ridge, both kinds weighing the same."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (share * (y - p)) - 1e-2 * w
        w = w + np.linalg.solve(design.T @ (design * (share * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def decoded(value: pa.Scalar) -> str:
    raw = value.as_py()
    return "" if raw is None else raw.decode("utf-8", "replace")


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> Machine | None:
    """Fits on labelled rows outside `fold`: at most TOXIC_ROWS and CLEAN_ROWS of them, and of each so many words.

    Labels other than 0 and 1 and rows without doc_id are left out; None where either label has no row.
    """
    docs, hashed = docs.select("doc_id", "text"), F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = None
    for label, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        own = known.where(F.col("toxic") == label).select("_id", "toxic", F.xxhash64(F.col("_id").cast("string")).alias("_h")).orderBy("_h", "_id").limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("_id")).select("toxic", hashed.alias("h"), "doc_id", "text")

    def run(batches):
        for batch in batches:
            bags = []
            for value in batch.column(3).cast(pa.binary()):
                own = usable(words(decoded(value)))
                bags.append(sorted(own, key=lambda w: (zlib.crc32(w.encode("utf-8", "replace")), w))[:ROW_WORDS])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bags, pa.list_(pa.string()))], names=["toxic", "h", "words"])

    got = arrow_map(rows, run, "toxic int, h long, words array<string>").orderBy("h", "toxic", "words").limit(2 * (TOXIC_ROWS + CLEAN_ROWS)).toArrow()
    own = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.string()))
    words_of = own.flatten().dictionary_encode()
    order = np.argsort(np.array(words_of.dictionary.to_pylist(), object), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    place = rank[words_of.indices.to_numpy(zero_copy_only=False)] if len(words_of) else np.zeros(0, np.int64)
    bags = [np.sort(place[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])]
    return fit(bags, np.array(got.column("toxic").to_pylist(), bool), [words_of.dictionary[int(i)].as_py() for i in order])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, strongest (the word that decides).

    The score reads the text alone, and all of it.  A null or empty text or one without a word of three letters has the score of a
    clean one, 0, and no strongest word; ties go to the first word in order.  Repeated rows are scored each, other columns are not read, an empty table gives an empty one.  Where
    the labels cannot train a machine, which takes both kinds, every score is 0.
    """
    model = fit_toxicity(docs, labels)
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast({"table": model.table.astype(np.float32), "rest": (model.bias, model.slope, model.shift)}) if model else None

    def run(batches):
        now = Machine(sent.value["table"], *sent.value["rest"]) if sent else None
        known: dict[str, float] = {}
        for batch in batches:
            score, strongest = np.zeros(batch.num_rows), [None] * batch.num_rows
            if now:
                if len(known) > REMEMBERED:
                    known = {}
                bags = [usable(words(decoded(v))) for v in batch.column(1).cast(pa.binary())]
                new = list({w for bag in bags for w in bag if w not in known})
                known.update(zip(new, now.of_words(new).tolist()))
                for i, bag in enumerate(bags):
                    if bag:
                        value = max(map(known.__getitem__, bag))
                        score[i], strongest[i] = now.score(value), min(w for w in bag if known[w] == value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), pa.array(strongest, pa.string())], names=["doc_id", "score", "predicted", "strongest"])

    scored = arrow_map(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, strongest string")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted", "strongest")
