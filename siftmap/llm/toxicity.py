"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the words, word pairs and beginnings of words that a text holds. For labelled texts with identity terms, versions with the term
exchanged for others of its kind are formed, and the squared change of the score (in log odds) is a penalty of the fit; so the
weight goes to what is said, not to the group it is said about, and neutral mentions are not flagged.

The fit uses a bounded sample of labelled rows (`max_rows`, those of the smallest hash of the id) and `max_features` features;
every text is scored in full.

Defined cases: a null text counts as empty and scores as the share of toxic labels would; a document with several labels counts
by their mean (a tie is toxic); null labels and null ids are not learned from; without labels of both kinds every score is the
share of toxic ones (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.llm.wordhash import ALNUM, Chunk, Words, chunks, heads, mix, shingles, words

MAX_ROWS = 16_000
MAX_FEATURES = 3000
MIN_DOCS = 4
#: Standard errors by which a feature's share of toxic texts differs from the overall one; fewer are left out as chance.
LEAST_Z = 2.2
PENALTY = 4.0
RIDGE = 0.5
STEPS = 300
#: Bytes of the beginnings of words that are features.
HEADS = (4, 5, 6, 7, 8)
#: Versions of a labelled text with its identity terms exchanged.
SWAPS = 2

#: Exchangeable terms, by kind.
IDENTITIES = {
    "gender": "woman man",
    "genders": "women men",
    "child": "girl boy",
    "sex": "female male",
    "faith": "christian muslim jewish hindu buddhist atheist catholic protestant sikh",
    "faiths": "christians muslims jews hindus buddhists atheists catholics protestants sikhs",
    "origin": "black white asian african european american arab mexican indian chinese latino",
    "orientation": "gay lesbian straight bisexual heterosexual homosexual queer",
    "identity": "transgender cisgender nonbinary",
    "age": "young old elderly teenage",
    "ability": "disabled deaf blind autistic",
    "role": "immigrant refugee foreigner citizen",
    "roles": "immigrants refugees foreigners citizens",
}


def _hash(terms: list[str]) -> np.ndarray:
    """Word hashes of single words."""
    return np.concatenate([words(c, ALNUM).hash for c in chunks(pa.array(terms))])


class Swaps:
    """Identity terms by hash, with the others of their kind."""

    def __init__(self, identities: dict[str, str]):
        kinds = [v.lower().split() for v in identities.values()]
        self.hash = _hash([t for kind in kinds for t in kind])
        self.order = np.argsort(self.hash)
        size = np.array([len(kind) for kind in kinds])
        self.first = np.repeat(np.cumsum(size) - size, size)
        self.size = np.repeat(size, size)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Which words are identity terms."""
        known = self.hash[self.order]
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def exchange(self, hashes: np.ndarray, salt: int) -> np.ndarray | None:
        """The words with each identity term replaced by another one of its kind; None if there is none."""
        at = np.minimum(np.searchsorted(self.hash[self.order], hashes), len(self.hash) - 1)
        term = self.order[at]
        hit = np.flatnonzero(self.hash[term] == hashes)
        if not len(hit):
            return None
        t = term[hit]
        step = 1 + (mix(self.hash[t] + np.uint64(salt)) % np.maximum(self.size[t] - 1, 1).astype(np.uint64)).astype(np.int64)
        out = hashes.copy()
        out[hit] = self.hash[self.first[t] + (t - self.first[t] + step) % self.size[t]]
        return out


def _features(chunk: Chunk, w: Words, swaps: Swaps) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word, word pair and beginning of a word; identity terms are taken as whole words only."""
    pair, at = shingles(w, 2)
    rows, hashes = [w.row, w.row[at]], [w.hash, pair]
    own = swaps.terms(w.hash)
    for size in HEADS:
        head, at = heads(chunk, w, ALNUM, size)
        free = ~own[at]
        rows.append(w.row[at[free]])
        hashes.append(head[free])
    return np.concatenate(rows), np.concatenate(hashes)


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, swaps: Swaps):
        self.swaps = swaps
        self.order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[self.order], weights[self.order], bias

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of features, -1 for none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def held(self, chunk: Chunk, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) of a chunk."""
        row, h = _features(chunk, w, self.swaps)
        f = self.find(h)
        row, f = row[f >= 0], f[f >= 0]
        both = np.unique(row * max(len(self.keys), 1) + f)
        return both // max(len(self.keys), 1), both % max(len(self.keys), 1)

    def scores(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for chunk in chunks(pa.compute.utf8_lower(column)):
            row, f = self.held(chunk, words(chunk, ALNUM))
            z = np.bincount(row, self.weights[f], len(chunk.offsets) - 1) + self.bias
            yield chunk.first, 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _select(sample: DataFrame, swaps: Swaps, max_features: int, min_docs: int) -> np.ndarray:
    """Hashes of the features that tell the classes apart most, and of all identity terms."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            for chunk in chunks(pa.compute.utf8_lower(batch.column(0))):
                row, h = _features(chunk, words(chunk, ALNUM), swaps)
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, y = h[new], label[chunk.first + row[new]]
                key, at = np.unique(h, return_index=True)
                if len(key):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "toxic": pa.array(np.add.reduceat(y, at)), "rows": pa.array(np.diff(np.append(at, len(h))))})

    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    counts = sample.select("text", "label").mapInArrow(run, "key bigint, toxic bigint, rows bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    share = toxic / n
    z = F.abs(F.col("toxic") - F.col("rows") * share) / F.sqrt(F.col("rows") * share * (1 - share) + 1)
    best = counts.where((F.col("rows") >= min_docs) & (z >= LEAST_Z)).orderBy(z.desc(), "key").limit(max_features).select("key").toArrow()
    return np.unique(np.concatenate([best.column("key").to_numpy().view(np.uint64), swaps.hash]))


def _matrix(sample: DataFrame, model: Model, swaps: Swaps, versions: int) -> pa.Table:
    """label, features, and for each exchanged version the features gained and lost, of the sample's rows."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            for chunk in chunks(pa.compute.utf8_lower(batch.column(0))):
                w = words(chunk, ALNUM)
                texts = len(chunk.offsets) - 1
                row, f = model.held(chunk, w)
                cut = np.searchsorted(row, np.arange(texts + 1))
                own = [f[cut[k]:cut[k + 1]] for k in range(texts)]
                gained, lost = [[] for _ in range(texts)], [[] for _ in range(texts)]
                for v in range(versions):
                    other = swaps.exchange(w.hash, v)
                    if other is None:
                        break
                    row, f = model.held(chunk, w._replace(hash=other))
                    cut = np.searchsorted(row, np.arange(texts + 1))
                    for k in range(texts):
                        new = f[cut[k]:cut[k + 1]]
                        plus, minus = np.setdiff1d(new, own[k]), np.setdiff1d(own[k], new)
                        if len(plus) or len(minus):
                            gained[k].append(plus)
                            lost[k].append(minus)
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(label[chunk.first:chunk.first + texts]), "features": pa.array(own, pa.list_(pa.int64())),
                    "gained": pa.array(gained, pa.list_(pa.list_(pa.int64()))), "lost": pa.array(lost, pa.list_(pa.list_(pa.int64())))})

    return sample.select("text", "label").mapInArrow(run, "label bigint, features array<bigint>, gained array<array<bigint>>, lost array<array<bigint>>").toArrow()


def _sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in lists], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in lists)])
    return np.repeat(np.arange(len(lists)), n), flat


def solve(features: list, labels: np.ndarray, gained: list, lost: list, size: int, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias: mean log loss + penalty * mean squared change under exchange + ridge, by gradient descent with adapted steps."""
    row, col = _sparse(features)
    plus_row, plus = _sparse(gained)
    minus_row, minus = _sparse(lost)
    n, pairs = len(labels), len(gained)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    theta = np.zeros(size + 1)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        w = theta[:-1]
        z = np.bincount(row, w[col], n) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        g = np.bincount(col, error[row], size) + ridge * w / n
        if pairs:
            change = np.bincount(plus_row, w[plus], pairs) - np.bincount(minus_row, w[minus], pairs)
            change *= 2 * penalty / pairs
            g += np.bincount(plus, change[plus_row], size) - np.bincount(minus, change[minus_row], size)
        g = np.append(g, error.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        rate = 0.08 * (1 - t / (steps + 1)) + 0.002
        theta -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-10)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, identities: dict[str, str] | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
        min_docs: int = MIN_DOCS, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Learns from `labels` (doc_id, toxic) and the texts of `docs` (doc_id, text)."""
    swaps = Swaps(identities or IDENTITIES)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("marked"), "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(rows.join(F.broadcast(marks), F.col("doc_id") == F.col("marked")).select("text", "label"), "labelled")
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < toxic < n:
        share = (toxic or 0) / n if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if share else -40.0, swaps)
    keys = _select(sample, swaps, max_features, min_docs)
    model = Model(keys, np.zeros(len(keys)), 0.0, swaps)
    table = _matrix(sample, model, swaps, SWAPS)
    pairs = [(p, m) for g, d in zip(table.column("gained").to_pylist(), table.column("lost").to_pylist()) for p, m in zip(g, d)]
    y = table.column("label").to_numpy().astype(float)
    features = [v.values.to_numpy() if v.values is not None else [] for v in table.column("features")]
    weights, bias = solve(features, y, [p for p, _ in pairs], [m for _, m in pairs], len(keys), penalty, ridge, steps)
    model.weights, model.bias = weights, bias
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every row of `docs` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            out = np.full(len(batch), 1 / (1 + np.exp(-model.bias)))
            for first, s in model.scores(batch.column(1)):
                out[first:first + len(s)] = s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
