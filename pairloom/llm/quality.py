"""Quality classifier without labels: labelling rules, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posteriors.

Overlapping rules vote good, bad or abstain from statistics of a text. Texts with the
same votes are alike to the label model, so the count of every vote pattern over all
documents (at most 3 ** rules) is all that EM needs: it alternates between each
pattern's posterior and each rule's vote frequencies given the class. A bounded
sample of documents with their posteriors then trains logistic regression over hashed
features: character-class trigrams and binned statistics of the whole text. The
scorer decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ship, stored, trim, whole_text
from pairloom.llm.scanner import chunks
from pairloom.llm.words import mixed, word_hashes

STATS = ("words", "symbols", "upper", "distinct", "repeats", "length", "stops", "lone", "shouts", "digits")
#: Dimensions of the scorer, and the most documents that it is trained on.
DIMENSIONS, TRAIN_ROWS = 1 << 12, 4096
LOWER_LETTER, UPPER_LETTER, DIGIT, BLANK, STOP, SHOUT, SYMBOL = range(7)
CLASSES = 7
#: Bins of the statistics as features.
EDGES = {
    "words": (1, 5, 20, 100, 1000), "symbols": (0.005, 0.02, 0.05, 0.1, 0.2), "upper": (0.02, 0.06, 0.15, 0.3, 0.6), "distinct": (0.1, 0.3, 0.45, 0.6, 0.9),
    "repeats": (0.01, 0.05, 0.2, 0.5), "length": (2.5, 4, 8, 12, 20), "stops": (0.01, 0.04, 0.3, 0.6), "lone": (0.01, 0.05, 0.1, 0.3), "shouts": (0.005, 0.05, 0.2, 0.5), "digits": (0.02, 0.1, 0.3),
}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        out[c] = BLANK if ch.isspace() else UPPER_LETTER if ch.isupper() else LOWER_LETTER if ch.isalpha() or ch in "'’-" else DIGIT if ch.isdigit() else STOP if ch in ".,;:?()\"" else SHOUT if ch == "!" else SYMBOL
    return out


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics (a row a text, columns as in STATS) and character-class trigram counts."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    cls = _classes().take(points)
    owner = np.repeat(np.arange(n), lengths)
    per = np.bincount(owner * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    whole = owner[2:] == owner[:-2]
    code = (cls[:-2].astype(np.int64) * CLASSES + cls[1:-1]) * CLASSES + cls[2:] if len(cls) > 2 else np.empty(0, np.int64)
    grams = np.bincount((owner[2:] * CLASSES**3 + code)[whole] if len(code) else code, minlength=n * CLASSES**3).reshape(n, CLASSES**3)
    begins, ends = np.r_[True, (cls[:-1] == BLANK) | (owner[1:] != owner[:-1])], np.r_[(cls[1:] == BLANK) | (owner[1:] != owner[:-1]), True]
    lone_at = np.flatnonzero((cls >= STOP) & begins & ends) if len(cls) else np.empty(0, np.int64)
    lone = np.bincount(owner[lone_at], minlength=n)
    hashes, bounds = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts], lower=False)
    words = np.diff(bounds)
    of = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    distinct = np.bincount(o[np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]] if len(h) else o, minlength=n)
    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(h) else np.zeros(n)
    w, letters, marks = np.maximum(words, 1), per[:, LOWER_LETTER] + per[:, UPPER_LETTER], np.maximum(lengths - per[:, BLANK], 1)
    stats = np.column_stack([
        words, per[:, SYMBOL] / marks, per[:, UPPER_LETTER] / np.maximum(letters, 1), distinct / w, again / w,
        (lengths - per[:, BLANK]) / w, per[:, STOP] / w, lone / w, per[:, SHOUT] / w, per[:, DIGIT] / marks,
    ])
    return stats, grams


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of the rules, a column each: 1 bad, 0 good, 2 abstains. Rules on rates
    abstain on texts too short to have one."""
    s = dict(zip(STATS, stats.T))
    some, many = s["words"] >= 5, s["words"] >= 30
    rule = lambda bad, good: np.where(bad, 1, np.where(good, 0, 2))
    # A text's own share of distinct words falls with its length.
    expected = np.clip(0.75 - 0.06 * np.log10(np.maximum(s["words"], 30) / 30), 0.5, 0.75)
    return np.column_stack([
        rule(s["symbols"] > 0.05, s["symbols"] < 0.01),
        rule(some & (s["upper"] > 0.3), s["upper"] < 0.1),
        rule(many & (s["distinct"] < 0.55 * expected), s["distinct"] > 0.8 * expected),
        rule(some & (s["repeats"] > 0.2), some & (s["repeats"] < 0.05)),
        rule(some & (s["lone"] > 0.1), s["lone"] < 0.02),
        rule(some & (s["shouts"] > 0.2), s["shouts"] < 0.02),
        rule(many & (s["stops"] < 0.02), many & (s["stops"] > 0.05) & (s["stops"] < 0.5)),
    ]).astype(np.int8)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, kinds: int | None = None, false_alarm: float = 0.01, prior_bad: float = 0.15, rounds: int = 300, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows) and their counts. Returns each pattern's posterior of
    bad, how often a rule that votes says bad [rule, good or bad], and the share of bad.

    Bad texts are of several kinds, each noticed by other rules, so the latent classes
    are good and a number of kinds of bad: one for each rule, which at first that rule
    mostly notices and the others seldom do, or a single one. An abstention says
    nothing. false_alarm bounds how often a rule says bad of a good text; pseudo-counts
    keep frequencies from 0 and 1."""
    rules = patterns.shape[1]
    kinds = kinds or rules
    rate = np.full((rules, kinds + 1), 0.2 if kinds > 1 else 0.8)  # of saying bad
    rate[:, 0] = min(false_alarm, 0.2)
    if kinds > 1:
        rate[np.arange(rules), 1 + np.arange(rules) % kinds] = 0.9
    share, last = np.r_[1 - prior_bad, np.full(kinds, prior_bad / kinds)], -np.inf
    says_bad, says_good = (patterns == 1).astype(float), (patterns == 0).astype(float)
    for _ in range(rounds):
        ll = np.log(share)[:, None] + (says_bad @ np.log(rate) + says_good @ np.log1p(-rate)).T
        top = ll.max(0)
        norm = top + np.log(np.exp(ll - top).sum(0))
        weight = counts * np.exp(ll - norm)  # class, pattern
        bad, good = says_bad.T @ weight.T, says_good.T @ weight.T
        rate = (bad + 0.02) / (bad + good + 0.04)
        rate[:, 0] = np.minimum(rate[:, 0], false_alarm)
        share = (weight.sum(1) + 0.02) / (counts.sum() + 0.02 * len(share))
        total = float((counts * norm).sum())
        if abs(total - last) < tol * abs(total):
            break
        last = total
    post = 1 - np.exp(ll[0] - norm)
    two = np.stack([weight[0], weight[1:].sum(0)])
    bad, good = says_bad.T @ two.T, says_good.T @ two.T
    return post, (bad + 1e-9) / (bad + good + 2e-9), float(two[1].sum() / max(1e-9, counts.sum()))


def hashed(stats: np.ndarray, grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Feature vectors: log-scaled trigram shares and bin indicators, each at a hashed place."""
    x = np.zeros((len(stats), dimensions))
    place = (mixed(np.arange(CLASSES**3, dtype=np.uint64)) % np.uint64(dimensions)).astype(np.int64)
    share = np.log1p(100 * grams / np.maximum(grams.sum(1, keepdims=True), 1)) / np.log(101)
    np.add.at(x.T, place, share.T)
    for k, name in enumerate(STATS):
        key = mixed(np.uint64(1000 * (k + 1)) + np.searchsorted(EDGES[name], stats[:, k]).astype(np.uint64))
        x[np.arange(len(x)), (key % np.uint64(dimensions)).astype(np.int64)] += 1
    return x


def train_scorer(x: np.ndarray, target: np.ndarray, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch accelerated gradient steps."""
    used = np.flatnonzero(x.any(0))
    z = np.c_[x[:, used], np.ones(len(x))]
    w = v = np.zeros(z.shape[1])
    rate = 4 / (np.linalg.norm(z, ord="fro") ** 2 / len(z) + 4 * l2)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - rate * (z.T @ (p - target) / len(z) + l2 * np.r_[v[:-1], 0])
        v, w = new + t / (t + 3) * (new - w), new
    out = np.zeros(x.shape[1])
    out[used] = w[:-1]
    return out, float(w[-1])


class QualityModel:
    """The label model by vote pattern, and the scorer."""

    def __init__(self, posterior: dict[int, float], frequencies: np.ndarray, weights: np.ndarray, bias: float):
        self.posterior, self.frequencies, self.weights, self.bias = posterior, frequencies, weights, bias

    def score(self, stats: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The scorer's probability of bad."""
        return 1 / (1 + np.exp(-np.clip(hashed(stats, grams, len(self.weights)) @ self.weights + self.bias, -30, 30)))


def pattern_code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1])


def _batches(batches: Iterator[pa.RecordBatch]):
    trim()
    for batch in batches:
        # A chunk's feature matrix has a row for each text, so short texts count more.
        for part in chunks(zip(*(c.to_pylist() for c in batch.columns)), lambda r: len(r[-1]) + 512, 1 << 18):
            yield part, text_features([r[-1] for r in part])
    trim()


def fit_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Patterns are counted over all documents; the scorer is trained on the train_rows
    documents whose ids and lengths hash lowest, which is the same sample at every
    partitioning. Only patterns and the sample's features reach the driver."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        for part, (stats, grams) in _batches(batches):
            code = pattern_code(votes(stats))
            kept = [s.tobytes() for s in np.c_[stats, grams].astype("<f4")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(code), pa.array(kept, pa.binary())], ["h", "pattern", "features"])

    text = whole_text()
    made = docs.select(F.xxhash64("doc_id", F.length(text)).alias("h"), text.alias("text")).mapInArrow(run, "h long, pattern long, features binary")
    made = stored(made, "quality-features")
    found = {r.pattern: r.n for r in made.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules = votes(np.zeros((1, len(STATS)))).shape[1]
    codes = np.array(sorted(found), np.int64)
    patterns = codes[:, None] // 3 ** np.arange(rules) % 3
    if not len(codes):
        return QualityModel({}, np.zeros((rules, 2)), np.zeros(DIMENSIONS), -1.0)
    post, freq, _ = fit_label_model(patterns, np.array([found[c] for c in codes.tolist()], float))
    posterior = dict(zip(codes.tolist(), post.tolist()))
    lowest = made.select("h").orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = made.filter(F.col("h") <= lowest).orderBy("h", "pattern").limit(train_rows).collect()
    raw = np.stack([np.frombuffer(r.features, "<f4") for r in sample]).astype(float)
    weights, bias = train_scorer(hashed(raw[:, : len(STATS)], raw[:, len(STATS) :]), np.array([posterior[r.pattern] for r in sample]))
    return QualityModel(posterior, freq, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, pattern, weak_label, score, kept of every row. weak_label is the label
    model's posterior of bad, score the scorer's probability of bad; a document is
    kept when the score is below a half. Null and empty texts abstain or look good
    and are kept; repeated rows give repeated rows."""
    ship(docs.sparkSession)

    def run(batches):
        for part, (stats, grams) in _batches(batches):
            code = pattern_code(votes(stats))
            score = model.score(stats, grams)
            weak = [model.posterior.get(c, 0.0) for c in code.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(code), pa.array(weak), pa.array(score), pa.array(score < 0.5)], ["doc_id", "pattern", "weak_label", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, pattern long, weak_label double, score double, kept boolean")


def quality_classifier(docs: DataFrame) -> DataFrame:
    """Fits on the documents and scores them all."""
    return score_quality(docs, fit_quality(docs))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns. Rows pass through
    the scorer with their text, so nothing is joined or shuffled."""
    model = fit_quality(docs)
    ship(docs.sparkSession)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        trim()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.concatenate([model.score(*text_features(part)) < 0.5 for part in chunks(texts, lambda t: len(t) + 512, 1 << 18)] or [np.empty(0, bool)])
            yield batch.filter(pa.array(keep))
        trim()

    return docs.mapInArrow(run, schema)
