"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a lexicon (words weighted by what the labels say of them, as they stand,
by their first letters, and with look-alike signs undone), the strongest and the summed weight, lexicon words near
a second person, capitals, punctuation, repeated letters, and how many words are obfuscated.

The lexicon and the trees are learned from the labels: every labelled row of the training folds up to
`TRAIN_ROWS` (those of the smallest hashes, a stated bound), in which term counts are taken for whole texts.
A row's own label must not speak through the lexicon, so training features are cross-fitted: each fold's
features come from the lexicon of the other folds. Calibration uses cross-fitted margins as well. Only the
text is an input of a score. The model has a bounded size and goes to the executors in the function.

Defined results: null and empty texts have all features zero and get that row's score; labels other than 0 or 1 and
labels without a document teach nothing; documents labelled twice teach twice; without any label of one
class every score is the share of the other; a null doc_id hashes as the empty text; rows may repeat;
an empty table gives an empty result; extra columns are ignored, and kept by `drop_toxic`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.boosting import Boosted, calibrated, fit_boosted, fit_isotonic
from emberline.llm.common import find_package, table

#: Labelled rows that the model learns from at most.
TRAIN_ROWS = 8_000
FOLDS = 3
#: Words' first letters that may be lexicon entries.
PREFIXES = (4, 5, 6)
#: A lexicon entry occurs in so many toxic training texts at least, and is so much likelier in them.
LEAST_TEXTS = 4
LEAST_RATIO = 8.0

# Second persons of the corpus languages, signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te ton ta tes toi vous votre vos ti tú usted ustedes vosotros tus su sus".split()
)
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
NEAR = 5

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$!|*'’_.-]*[\p{L}\p{N}][\p{L}\p{M}\p{N}@$!|*'’_.-]*")
_EDGES = "!|*'’_.-$@"
_AROUND = _EDGES + ",;:?()[]{}\"«»“”„…"
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
#: Words and tokens that a task remembers.
REMEMBERED = 50_000
_INNER = regex.compile(r"[^\p{L}\p{M}]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W\d_])")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_PUNCTUATION = re.compile(r"[!?]")


def folded(word: str) -> tuple[str, bool]:
    """A word with look-alike signs and signs between letters undone, and whether that changed it."""
    bare = word.strip(_EDGES)
    if bare.isalpha():
        return bare, False
    letters = sum(c.isalpha() for c in bare)
    if letters < 2 or letters * 2 < len(bare):
        return bare, False
    plain = _INNER.sub("", bare.translate(LOOK_ALIKE))
    return plain, plain != bare


def terms_of(word: str) -> list[str]:
    """Lexicon entries that a folded word can hit: itself and its first letters."""
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]


_tokens: dict[str, tuple[tuple[str, ...], int]] = {}


def _token_words(token: str) -> tuple[tuple[str, ...], int]:
    """Folded words of a token that is not letters alone, and how many were obfuscated."""
    known = _tokens.get(token)
    if known is None:
        if len(_tokens) > REMEMBERED:
            _tokens.clear()
        bare = token.strip(_AROUND)
        if bare.isalpha():
            known = ((bare,), 0)
        else:
            parts = [folded(x) for x in _WORD.findall(token)]
            known = (tuple(w for w, _ in parts if w), sum(changed for w, changed in parts if w))
        _tokens[token] = known
    return known


def words_of(text: str) -> tuple[list[str], int]:
    """Folded lower-case words, and how many were obfuscated."""
    lowered = text.lower()
    hidden = 0
    out = []
    for spaced in _SPACED.findall(lowered):
        out.append(_INNER.sub("", spaced))
        hidden += 1
    for token in lowered.split():
        if token.isalpha():
            out.append(token)
        else:
            found, changed = _token_words(token)
            out += found
            hidden += changed
    if _REPEATED.search(lowered):
        out = [_REPEATED.sub(r"\1", w) if len(w) > 3 else w for w in out]
    return out, hidden


class Lexicon:
    """Weights of terms: how much likelier they are in toxic texts (log ratio)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        known = self.known.get(word)
        if known is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known[word] = max((self.weights.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return known

    @classmethod
    def learn(cls, docs: TermSets, y: np.ndarray, rows: np.ndarray) -> Lexicon:
        """From the given rows of the training texts."""
        toxic, clean = (docs.counts(rows & (y == k)) for k in (1, 0))
        share = (toxic + 0.5) / ((rows & (y == 1)).sum() + 1)
        ratio = share / ((clean + 0.5) / ((rows & (y == 0)).sum() + 1))
        chosen = set(np.flatnonzero((toxic >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).tolist())
        return cls({t: float(np.log(ratio[i])) for t, i in docs.number.items() if i in chosen})


class TermSets:
    """Distinct terms of each training text, as numbers."""

    def __init__(self, texts: list[str | None]) -> None:
        self.number: dict[str, int] = {}
        number = self.number
        sets = []
        for text in texts:
            found = {number.setdefault(t, len(number)) for w in set(words_of(text or "")[0]) for t in terms_of(w)}
            sets.append(np.fromiter(found, dtype=np.int32, count=len(found)))
        self.sizes = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int32)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts each term occurs."""
        return np.bincount(self.flat[np.repeat(rows, self.sizes)], minlength=len(self.number)).astype(np.float64)


N_FEATURES = 14


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    words, hidden = words_of(text or "")
    if not words:
        return [0.0] * N_FEATURES
    n = len(words)
    # Each distinct word is looked up once.
    counts = Counter(words)
    known = lexicon.known
    hits = {w: x for w in counts if (x := known[w] if w in known else lexicon.weight(w))}
    hit_count = sum(counts[w] for w in hits)
    total = sum(counts[w] * x for w, x in hits.items())
    near = 0
    if hits and not SECOND_PERSON.isdisjoint(counts):
        persons = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        at = np.array([i for i, w in enumerate(words) if w in hits])
        k = np.searchsorted(persons, at)
        gap = np.minimum(np.abs(persons[np.minimum(k, len(persons) - 1)] - at), np.abs(at - persons[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    raw = text or ""
    capitals = len(_CAPITALS.findall(raw))
    return [
        hit_count, len(hits), 100 * hit_count / n, 100 * total / n, max(hits.values(), default=0.0), min(total, 200.0),
        near, 100 * near / n, 100 * sum(counts[w] for w in SECOND_PERSON if w in counts) / n,
        100 * capitals / n, 100 * len(_PUNCTUATION.findall(raw)) / n, 100 * hidden / n, min(hidden, 50), float(np.log1p(n)),
    ]


def forget(lexicon: Lexicon) -> None:
    """Give back what a task has remembered; Python workers outlive their tasks."""
    _tokens.clear()
    lexicon.known.clear()


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted, knots: tuple[np.ndarray, np.ndarray], constant: float | None = None) -> None:
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)
        margin = self.trees.margin(x)
        # The step line leaves margins within a step equal; a little of the margin itself keeps them in order.
        return np.clip(calibrated(self.knots, margin) + 5e-4 * np.tanh(margin / 10), 0.0, 1.0)


def crc_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of the training rows: of all that are labelled and not held out those of the smallest hashes, at most `rows`."""
    marks = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("__held", held_out).filter("NOT __held")
    # The bound is applied to ids before texts are joined, so texts of other rows don't move.
    some = marks.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")


def fit(rows: list[tuple[int, str | None, int]]) -> Model:
    """Model from (doc_id, text, label)."""
    y = np.array([r[2] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        return Model(Lexicon({}), Boosted(0.0, 0.1, []), (np.zeros(0), np.zeros(0)), float(y.mean()) if len(rows) else 0.5)
    found = TermSets([r[1] for r in rows])
    fold = np.array([zlib.crc32(f"fold {r[0]}".encode()) % FOLDS for r in rows])
    x = np.zeros((len(rows), N_FEATURES))
    for k in range(FOLDS):
        own = Lexicon.learn(found, y, fold != k)
        for i in np.flatnonzero(fold == k):
            x[i] = features(rows[i][1], own)
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        if (fold != k).any() and (fold == k).any():
            margin[fold == k] = fit_boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
    whole = Lexicon.learn(found, y, np.ones(len(rows), dtype=bool))
    return Model(whole, fit_boosted(x, y), fit_isotonic(margin, y))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents whose crc32(doc_id) mod 5 is not 0."""
    rows = labelled(docs, labels, crc_of(F.col("__id")) % 5 == 0)
    model = fit(sorted(((r[0], r[1], r[2]) for r in rows.collect()), key=lambda r: (r[0], r[2], r[1] or "")))
    forget(model.lexicon)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                p = model.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )
        forget(model.lexicon)

    rows = docs.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the model predicts to be toxic; all columns stay as they are."""
    find_package(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                keep = model.scores(part.column(part.schema.get_field_index("text")).to_pylist()) < 0.5
                yield part.filter(pa.array(keep))
        forget(model.lexicon)

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
