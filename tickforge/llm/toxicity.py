"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

The kernel compares short strings by the triples of characters that they have in common in that order, gaps
allowed: a triple that spans s characters weighs DECAY ** s, up to SPAN. So an insult with characters put in or left
out stays close to its plain form. A document is a bag of segments (its words; pieces of very long ones; runs of
single characters closed up). Segments of labelled documents train the machine: in a toxic document its worst
segment counts as toxic, in a clean one none does, and the clean segments that score worst are put back in as
negatives (multiple-instance training). A document's score is a logistic function of the scores of its worst words and
of how many different words it has: in a long text one that resembles an insult says less.

Against m landmarks the decision is a sum of m kernel values. Each is an inner product over triples, so their sum is
one weight for each triple: scoring a segment costs its triples, not m kernels.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, map_texts, released, small

#: Labelled documents of either class that train the classifier, at most; drawn by a hash of doc_id.
TRAIN = 2000
LANDMARKS, DECAY, SPAN = 192, 0.7, 6
#: Longer words are read in pieces of this length, each starting half a piece after the last.
PIECE = 24
CACHE = 150_000
#: Worst words of a text that count, and the score of those that a shorter text lacks.
WORST, NOTHING = 3, -1.5
SYMBOLS = 64
EDGES = ".,;:!?\"'()[]|»«"
SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
COMBOS = [(a, a + b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
WEIGHTS = np.array([DECAY ** (far + 1) for _, far in COMBOS], dtype=np.float32)


def symbol(c: str) -> int:
    """1 to 63: letters and digits have one each, the rest share what is left."""
    k = ord(c)
    if 97 <= k <= 122:
        return k - 96
    return k - 21 if 48 <= k <= 57 else 37 + k % 27


def segments(token: str) -> list[str]:
    """A lower-cased token without punctuation at its ends, and also closed up if others stand inside; long ones in overlapping pieces."""
    word = token.strip(EDGES) or token
    found = [word]
    if not word.isalnum() and (closed := "".join([c for c in word if c.isalnum()])):
        found.append(closed)
    return [w[k : k + PIECE] for w in found for k in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The feature map of words, as (word number, triple, weight) with equal triples of a word summed, and the norms.

    Each word is read with a mark at its start, so that prefixes weigh more.
    """
    n = len(words)
    length = max(map(len, words), default=0) + 1
    codes = np.zeros((n, length), dtype=np.int64)
    for row, word in zip(codes, words, strict=True):
        row[1 : len(word) + 1] = [symbol(c) for c in word]
    lengths = np.array([len(w) + 1 for w in words])
    codes[:, 0] = 36 + 27
    keys, weights = [], []
    for weight, (near, far) in zip(WEIGHTS, COMBOS, strict=True):
        if far >= length:
            continue
        key = codes[:, : length - far] << 12 | codes[:, near : length - far + near] << 6 | codes[:, far:]
        r, c = np.nonzero(np.arange(length - far) < (lengths - far)[:, None])
        keys.append(r << 18 | key[r, c])
        weights.append(np.full(len(r), weight, dtype=np.float32))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.ones(n)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    summed = np.add.reduceat(weight, first) if len(first) else weight
    key = key[first]
    word = key >> 18
    norms = np.sqrt(np.bincount(word, summed.astype(np.float64) ** 2, minlength=n))
    return word, key & (1 << 18) - 1, summed, np.where(norms > 0, norms, 1)


def linear(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Inner product of each word's unit feature vector with the weights of triples."""
    out = np.zeros(len(words))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of like length pad each other little
    for k in range(0, len(order), 4096):
        part = order[k : k + 4096]
        word, triple, value, norms = triples([words[i] for i in part])
        out[part] = np.bincount(word, value * weights[triple], minlength=len(part)) / norms
    return out


class Model(NamedTuple):
    weights: np.ndarray  # of triples
    bias: float
    logistic: tuple[float, ...]  # of the features of a text, and the constant


def kernel_to(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words against landmarks."""
    lw, lt, lv, ln = triples(landmarks)
    active, place = np.unique(lt, return_inverse=True)
    table = np.zeros((len(active) + 1, len(landmarks)), dtype=np.float32)
    table[place, lw] = lv / ln[lw]
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for k in range(0, len(words), 512):
        word, triple, value, norms = triples(words[k : k + 512])
        at = np.minimum(np.searchsorted(active, triple), len(active) - 1)
        hit = active[at] == triple
        word, value, at = word[hit], value[hit], at[hit]
        if len(word):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            out[k + word[starts]] = np.add.reduceat(table[at] * value[:, None], starts, axis=0) / norms[word[starts], None]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge support vector machine, by Newton steps on the violating rows."""
    full = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(full.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-3
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        part = full[active] * cost[active, None]
        w = np.linalg.solve(part.T @ full[active] + np.diag(reg), part.T @ y[active])
        now = y * (full @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def bag(text: str) -> set[str]:
    """The distinct segments of a text, empty for one without words."""
    text = text.lower()
    found = {s for token in set(text.split()) for s in segments(token)}
    for m in SINGLES.finditer(text):
        found.update(segments("".join(m[0].split())))
    return found


def variants(word: str) -> list[str]:
    """word with one character doubled, or a foreign one put in, at several places."""
    return [word[:k] + word[k - 1] + word[k:] for k in range(1, len(word) + 1, 2)] + [word[:k] + "x" + word[k:] for k in range(2, len(word), 2)]


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """A model from labelled texts. With one class only, or none, every text gets the share of that class."""
    y = np.array([1 if v else 0 for v in labels])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << 18, np.float32), -1.0, (*[0.0] * (WORST + 1), float(np.log((share + 0.01) / (1.01 - share)))))
    # Many texts share their segments: one string of each is kept, and tuples, which are smaller than sets and in their order.
    one: dict[str, str] = {}
    bags = [tuple([one.setdefault(s, s) for s in bag(t)]) for t in texts]
    toxic = Counter(s for b, v in zip(bags, y, strict=True) if v for s in b)
    clean = Counter(s for b, v in zip(bags, y, strict=True) if not v for s in b)
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    odds = {s: np.log((c + 0.1) / n_toxic) - np.log((clean[s] + 0.1) / n_clean) for s, c in toxic.items()}
    rng = np.random.default_rng(seed)
    # A toxic document's witnesses: its segments that speak most for the class, if several documents share them.
    witnesses: Counter = Counter()
    for b, v in zip(bags, y, strict=True):
        if v and b:
            best = max(odds[s] + 0.2 * np.log(toxic[s]) for s in b)
            witnesses.update(s for s in b if odds[s] + 0.2 * np.log(toxic[s]) >= best - 0.5 and odds[s] > 1)
    frequent = Counter({s: n for s, n in witnesses.items() if n >= max(3, n_toxic // 50)})  # stay, whatever later rounds find
    positives = [s for s, _ in witnesses.most_common(3000)]
    pool = sorted(clean)
    negatives = [pool[i] for i in rng.permutation(len(pool))[:4000]]
    weights, bias = np.zeros(1 << 18, np.float32), 0.0
    for _ in range(4):
        chosen = positives[: LANDMARKS // 2] + [negatives[i] for i in np.linspace(len(negatives) - 1, 0, LANDMARKS - len(positives[: LANDMARKS // 2])).astype(int)]
        chosen = list(dict.fromkeys(chosen))
        gram = kernel_to(chosen, chosen).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        bent = [v for s in list(frequent)[:200] if len(s) > 4 for v in variants(s) if v not in clean]
        words = positives + bent + negatives
        sign = np.array([1.0] * (len(positives) + len(bent)) + [-1.0] * len(negatives))
        cost = np.array([min(20.0, float(witnesses[s]) ** 0.5) for s in positives] + [1.0] * len(bent) + [min(20.0, float(clean[s])) for s in negatives])
        w, bias = svm(kernel_to(words, chosen) @ root, sign, cost)
        lw, lt, lv, ln = triples(chosen)
        weights = np.bincount(lt, lv / ln[lw] * (root @ w)[lw], minlength=1 << 18).astype(np.float32)
        scores = linear(pool, weights) + bias
        worst = [pool[i] for i in np.argsort(-scores)[:3000] if scores[i] > -1]
        negatives = list(dict.fromkeys(negatives + worst))
        by = dict(zip(toxic, linear(list(toxic), weights) + bias, strict=True))
        again: Counter = Counter()
        for b, v in zip(bags, y, strict=True):
            if v and b:
                best = max(b, key=by.__getitem__)
                again.update({s for s in b if by[s] > 0.5 and odds[s] > 0 and toxic[s] > 2} | ({best} if odds[best] > 0 else set()))
        witnesses = again | frequent or witnesses
        positives = [s for s, _ in witnesses.most_common(3000)]
    found = np.array(list(Scorer(Model(weights, bias, ())).features(texts)))
    return Model(weights, bias, logit(found, y))


def logit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps, classes weighed by their sizes as they are."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w)), full.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


class Scorer:
    """Scores texts with a model, remembering the scores of tokens."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > CACHE:
            self.known.clear()
        owners, words = [], []
        for t in tokens:
            for s in segments(t):
                owners.append(t)
                words.append(s)
        for t, v in zip(owners, (linear(words, self.model.weights) + self.model.bias).tolist(), strict=True):
            if v > self.known.get(t, -np.inf):
                self.known[t] = v

    def features(self, texts: list[str]) -> Iterator[list[float]]:
        """For each text, the scores of its worst different words, falling, and the logarithm of their number."""
        for k in range(0, len(texts), 64):
            split = []
            for t in texts[k : k + 64]:
                t = t.lower()
                tokens = set(t.split())
                if " " in t:
                    tokens.update("".join(m[0].split()) for m in SINGLES.finditer(t))
                split.append(tokens)
            everything = set().union(*split)
            if new := everything.difference(self.known):
                before = len(self.known)
                self.learn(new)
                if len(self.known) < before:  # the cache began anew
                    self.learn(everything.difference(self.known))
            known = self.known
            for tokens in split:
                worst = heapq.nlargest(WORST, map(known.__getitem__, tokens))
                yield [*worst, *[NOTHING] * (WORST - len(worst)), math.log1p(len(tokens))]

    def __call__(self, texts: list[str]) -> list[float]:
        *slopes, const = self.model.logistic
        out = []
        for found in self.features(texts):
            x = sum(a * b for a, b in zip(slopes, found, strict=True)) + const
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, x)))))
        return out


SCORERS: dict[str, Scorer] = {}


def scorer(key: str, model: Callable[[], Model]) -> Scorer:
    """One for each worker process and model, so that later tasks find the tokens known."""
    if key not in SCORERS:
        SCORERS.clear()
        SCORERS[key] = Scorer(model())
    return SCORERS[key]


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of doc_id as text is a multiple of 5. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most TRAIN labelled documents of either class, none of them held out.

    The chosen ids are few and broadcast; texts are not shuffled. Labels that are null count for nothing; of labels, and
    of documents, with the same id one counts (the larger label, the first text in order), so the driver gets 2 * TRAIN
    rows at most. Columns of any other names may stand beside. Without usable labels every score is the same.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    drawn = [usable.where(F.col("label") == v).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(TRAIN) for v in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    texts_, marks = [r.text for r in rows], [r.label for r in rows]
    del rows
    model = train(texts_, marks)
    del texts_
    released()  # the driver lives on
    return model


def score(docs: DataFrame, model: Model, **columns: str) -> DataFrame:
    """doc_id and score (0 to 1) of every text, row by row: repeated rows get equal scores, other columns don't matter.

    A null text is as an empty one, which has the score of no words. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # 1 MB, whatever the input
    key = hashlib.sha256(model.weights.tobytes() + repr(model[1:]).encode()).hexdigest()

    def make() -> Callable[[list[str]], dict[str, list]]:
        use = scorer(key, lambda: Model(*shared.value))
        return lambda texts: {"score": use(texts)}

    return map_texts(docs, make, "score double", **columns)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns and other rows stay as they are.

    Columns may have any names. A null text has the score of an empty one and stays null; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    key = hashlib.sha256(model.weights.tobytes() + repr(model[1:]).encode()).hexdigest()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = scorer(key, lambda: Model(*shared.value))
        for batch in small(batches, 256):
            scores = use([t or "" for t in batch.column(1).to_pylist()])
            yield batch.select([0]).filter(pa.array([s < threshold for s in scores], pa.bool_()))

    kept = rows.mapInArrow(run, rows.select("row").schema)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_toxicity_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
