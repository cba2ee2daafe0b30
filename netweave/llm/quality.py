"""Quality classifier from weak labels.

Overlapping heuristic labellers each call a document bad, good or nothing. Their
accuracies are not given: expectation-maximisation over the counts of all vote
patterns in the corpus estimates how often each is right. The posterior of a document's pattern is its label, and a logistic
model over hashed features (n-grams of byte classes, and buckets of the
document's summary figures) learns from these. It scores every document.

The vote counts cover all documents. The model is fitted on a bounded sample:
about ``train_rows`` documents, by hash, whatever the corpus.

Defined results: null and blank texts have no votes and score 0, so they are
rejected; repeated rows are scored alike; texts are read to their end, a piece
of about PIECE bytes at a time, which decides nothing; text without spaces, as of
Japanese, is one word to the labellers, of which few then vote; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS, BUCKETS, PIECE, GRAM = 8000, 4096, 1 << 20, 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# ---- classes of bytes: a kind for n-grams, and sets for figures ----------
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _QUOTE = 1, 2, 3, 4, 5, 6
_KIND = np.full(256, 7, np.uint8)
for _bytes, _kind in ((range(97, 123), _LOWER), (range(128, 256), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), (range(9, 14), _SPACE), (b" ", _SPACE), (b".,;:?", _STOP), (b"'\"()-/", _QUOTE)):
    _KIND[list(_bytes)] = _kind
for _byte in range(33, 127):  # every other symbol has a kind of its own
    if _KIND[_byte] == 7:
        _KIND[_byte] = 7 + _byte % 8
_SYMBOL = _KIND >= 7
_SYMBOL[: 33] = False
_POWERS = np.cumprod(np.full(64, _MULTIPLIER | np.uint64(1), np.uint64), dtype=np.uint64)


@dataclass
class Summary:
    """Counts of a text; pieces of one text add up."""

    size: int = 0
    letters: int = 0
    upper: int = 0
    symbols: int = 0
    words: int = 0
    again: int = 0
    stops: int = 0
    odd_ends: int = 0
    lines: int = 0
    distinct: int = 0
    distinct_lines: int = 0


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end]; runs are in order and do not meet."""
    place = np.arange(len(values)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(values)]))))
    weighted = (values.astype(np.uint64) + np.uint64(1)) * _POWERS[place % 64]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)))
    return (total[ends] - total[starts]) * _MULTIPLIER ^ (ends - starts).astype(np.uint64)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about PIECE bytes that end after white space, so no word is cut."""
    at = 0
    while at < len(raw):
        end, blank = at, np.zeros(0, np.int64)
        while end < len(raw) and not len(blank):
            begin, end = end, min(end + PIECE, len(raw))
            blank = np.flatnonzero(_KIND[raw[begin:end]] == _SPACE)
        if end < len(raw):
            end = begin + int(blank[-1]) + 1
        yield raw[at:end]
        at = end


class _Lines:
    """Hashes of the lines that have a word; a line may go on in the next piece."""

    def __init__(self) -> None:
        self.known, self.n, self.sum, self.words = np.zeros(0, np.uint64), 0, np.uint64(0), 0

    def close(self) -> None:
        if self.words:
            self._add(np.array([self.sum]), np.array([self.words]))
            self.sum, self.words = np.uint64(0), 0

    def _add(self, sums: np.ndarray, words: np.ndarray) -> None:
        self.known = np.union1d(self.known, sums * _MULTIPLIER ^ words.astype(np.uint64))
        self.n += len(sums)

    def read(self, hashes: np.ndarray, line_of: np.ndarray, breaks: int) -> None:
        """Words with the number of line feeds before each, of so many in the piece."""
        if breaks if not len(hashes) else line_of[0]:
            self.close()
        if not len(hashes):
            return
        first = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
        words = np.diff(np.concatenate((first, [len(hashes)])))
        place = np.arange(len(hashes)) - np.repeat(first, words)
        place[: words[0]] += self.words
        sums = np.add.reduceat(((hashes >> np.uint64(8)) + np.uint64(1)) * _POWERS[place % 64], first)
        sums[:1] += self.sum
        words[0] += self.words
        self._add(sums[:-1], words[:-1])
        self.sum, self.words = sums[-1], int(words[-1])
        if line_of[-1] < breaks:
            self.close()


def read(text: bytes, buckets: int = BUCKETS) -> tuple[Summary, np.ndarray]:
    """A text's summary, and its counts of hashed byte-class n-grams; read in
    pieces, with the same result wherever these end."""
    raw, out, grams = np.frombuffer(text, np.uint8), Summary(), np.zeros(buckets, np.int64)
    known, last, lines, before = np.zeros(0, np.uint64), None, _Lines(), np.zeros(0, np.uint8)
    for piece in _pieces(raw):
        kind = _KIND[piece]
        space = kind == _SPACE
        edges = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        out.size += len(piece)
        out.letters += int((kind == _LOWER).sum() + (kind == _UPPER).sum())
        out.upper += int((kind == _UPPER).sum())
        out.symbols += int(_SYMBOL[piece].sum())
        out.words += len(starts)
        hashes, feeds = _hashes(piece, starts, ends), np.cumsum(piece == 10)
        lines.read(hashes, feeds[starts], int(feeds[-1]))
        if len(starts):
            out.again += int((hashes[1:] == hashes[:-1]).sum()) + int(last is not None and last == hashes[0])
            last = hashes[-1]
            known = np.union1d(known, hashes)
            final = kind[ends - 1]
            out.stops += int((final == _STOP).sum())
            out.odd_ends += int(_SYMBOL[piece[ends - 1]].sum())
        kind = np.concatenate((before, kind))
        before = kind[-(GRAM - 1) :]
        if len(kind) >= GRAM:
            code = np.zeros(len(kind) - GRAM + 1, np.uint64)
            for i in range(GRAM):
                code = code * np.uint64(16) + kind[i : len(kind) - GRAM + 1 + i]
            grams += np.bincount(((code * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    lines.close()
    out.lines, out.distinct, out.distinct_lines = lines.n, len(known), len(lines.known)
    return out, grams


# ---- labellers ---------------------------------------------------------
NOTHING, BAD, GOOD = 0, 1, 2


def labels(s: Summary) -> tuple[int, ...]:
    """The votes of the labellers, in the order of LABELLERS."""
    n, letters, size = max(s.words, 1), max(s.letters, 1), max(s.size, 1)
    symbol, shout, stutter, variety, stop, odd = s.symbols / size, s.upper / letters, s.again / n, s.distinct / n, s.stops / n, s.odd_ends / n
    mean = s.letters / n
    return (
        BAD if symbol > 0.05 else NOTHING,
        BAD if shout > 0.4 and s.words >= 4 else NOTHING,
        BAD if stutter > 0.15 and s.words >= 10 else NOTHING,
        BAD if variety < 0.25 and s.words >= 30 else NOTHING,
        BAD if odd > 0.2 else NOTHING,
        BAD if stop < 0.02 and s.words >= 20 else NOTHING,
        BAD if s.distinct_lines < 0.4 * s.lines and s.lines >= 5 else NOTHING,
        GOOD if 0.05 <= stop <= 0.4 and stutter < 0.05 and symbol < 0.02 else NOTHING,
        GOOD if (variety > 0.45 or s.words < 30) and odd < 0.05 and shout < 0.15 else NOTHING,
        GOOD if 2 <= mean <= 10 and symbol < 0.02 and stutter < 0.1 and shout < 0.3 else NOTHING,
    )


LABELLERS = ("symbols", "shouting", "stutter", "poor vocabulary", "odd word ends", "no punctuation", "repeated lines", "sentence rhythm", "varied words", "plain words")


@dataclass
class VoteModel:
    """Prior of bad, and how often each labeller is right when it votes."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        weight = np.log(self.accuracy / (1 - self.accuracy))
        votes = (patterns == GOOD).astype(float) - (patterns == BAD)
        return 1 / (1 + np.exp(-(votes @ weight + np.log(1 / self.prior - 1))))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over vote patterns and how often they come; a
    labeller that says nothing tells nothing. Eight right and two wrong votes
    are added to each labeller's."""
    model = VoteModel(0.2, np.full(patterns.shape[1], 0.8))
    good_vote, bad_vote = (patterns == GOOD) * counts[:, None], (patterns == BAD) * counts[:, None]
    cast = good_vote.sum(0) + bad_vote.sum(0)
    for _ in range(rounds):
        good = model.posterior(patterns)[:, None]
        right = (good * good_vote + (1 - good) * bad_vote).sum(0)
        new = VoteModel(float((((1 - good[:, 0]) * counts).sum() + 1) / (counts.sum() + 2)), (right + 8) / (cast + 10))
        moved = max(abs(new.prior - model.prior), float(np.abs(new.accuracy - model.accuracy).max()))
        model = new
        if moved < 1e-9:
            break
    return model


# ---- scorer ------------------------------------------------------------


def _figures(s: Summary) -> np.ndarray:
    n, letters, size = max(s.words, 1), max(s.letters, 1), max(s.size, 1)
    return np.array([s.symbols / size, s.upper / letters, s.again / n, s.distinct / n, s.stops / n, s.odd_ends / n, s.distinct_lines / max(s.lines, 1), min(s.words, 200) / 200])


def features(s: Summary, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's hashed features: shares of n-grams,
    then a bucket of each figure with the figure's share of the bucket."""
    where = np.flatnonzero(grams)
    share = grams[where] / max(1, grams.sum())
    figures = _figures(s) * 10
    low = np.minimum(figures.astype(np.int64), 9)
    within = figures - low
    salt = (np.arange(len(figures)) * 16).astype(np.int64)
    slots = np.concatenate((salt + low, salt + low + 1)).astype(np.uint64)
    buckets = len(grams) + ((slots * _MULTIPLIER) >> np.uint64(48)).astype(np.int64) % (len(grams) // 4)
    return np.concatenate((where, buckets)), np.concatenate((np.sqrt(share), 1 - within, within))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, where: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[where] @ values + self.bias))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, epochs: int = 200, rate: float = 2.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on posterior labels, by full gradient steps with
    momentum; classes weigh the same."""
    index, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight = weight / weight.sum()
    weights, bias, step, step_bias = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(epochs):
        margin = np.bincount(owner, weights[index] * values, len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        step = 0.9 * step - rate * (np.bincount(index, error[owner] * values, size) + decay * weights)
        step_bias = 0.9 * step_bias - rate * float(error.sum())
        weights, bias = weights + step, bias + step_bias
    return Scorer(weights, bias)


@dataclass
class Model:
    votes: VoteModel
    scorer: Scorer
    buckets: int


def fit(df: DataFrame, text_col: str, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Model | None:
    """Vote counts of all documents, then the scorer of a sample of about
    train_rows. None if no document has a word."""
    texts = df.select(F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for t in batch.column(0) if (s := read(t.as_buffer().to_pybytes(), 1)[0]).words]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, labels(s))) for s in found], pa.string())], names=["votes"])

    counted = sorted((r["votes"], r["count"]) for r in texts.mapInArrow(vote, "votes string").groupBy("votes").count().collect())  # at most 3 ** labellers rows
    if not counted:
        return None
    patterns, counts = np.array([[int(c) for c in v] for v, _ in counted]), np.array([c for _, c in counted], float)
    votes = fit_votes(patterns, counts)
    part = min(1.0, train_rows / counts.sum())
    turn = F.pmod(F.xxhash64("__text"), F.lit(1 << 20)) + F.pmod(F.xxhash64(F.lit(1), "__text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = texts.filter(turn < F.lit(part * (1 << 20)))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0):
                s, grams = read(t.as_buffer().to_pybytes(), buckets)
                if s.words:
                    where, values = features(s, grams)
                    rows.append(("".join(map(str, labels(s))), where.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["votes", "places", "shares"])

    sample = sorted(tuple(r) for r in picked.distinct().mapInArrow(prepare, "votes string, places binary, shares binary").collect())
    if not sample:
        return Model(votes, Scorer(np.zeros(buckets + buckets // 4), float(np.log(1 / votes.prior - 1))), buckets)
    target = votes.posterior(np.array([[int(c) for c in v] for v, _, _ in sample]))
    rows = [(np.frombuffer(p, np.int32), np.frombuffer(s, np.float32).astype(float)) for _, p, s in sample]
    return Model(votes, fit_scorer(rows, target, buckets + buckets // 4), buckets)


def _scored(model: Model | None):
    """A function from a text's bytes to (words, posterior of its votes, score)."""

    def run(raw: bytes | None) -> tuple[int, float | None, float]:
        if model is None or raw is None:
            return 0, None, 0.0
        s, grams = read(raw, model.buckets)
        if not s.words:
            return 0, None, 0.0
        return s.words, float(model.votes.posterior(np.array([labels(s)]))[0]), model.scorer.score(*features(s, grams))

    return run


def classify(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, posterior, score, accepted) of each row: posterior of
    the labellers' votes, and the scorer's probability of good quality, which
    decides."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, text_col, train_rows))  # weights of fixed size
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(model.value)
        for batch in batches:
            found = [score(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)]
            words, posterior, scores = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64()), pa.array([x >= threshold for x in scores], pa.bool_())],
                names=["doc_id", "n_words", "posterior", "score", "accepted"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, posterior double, score double, accepted boolean")


def keep_accepted(df: DataFrame, text_col: str, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of df that the classifier accepts, in place."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, text_col, train_rows))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(model.value)
        for batch in batches:
            kept = [score(t.as_buffer().to_pybytes() if t.is_valid else None)[2] >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)
