"""Language identification by unigram models whose segmentations are summed out.

Each language has a probability for every piece of a fixed public vocabulary (its byte pieces cover what else there is). The
probability of a text is the sum over all its segmentations into pieces: a forward algorithm per word, done for many words at a
time; pieces do not cross words, and a word of more than 64 bytes is taken in stretches of 64. Piece probabilities come from
EM over the word counts of a bounded sample of labelled documents (`per_language`, about so many of each language, picked by a
hash of the id); every document is scored in full.

Defined cases: a null, empty or letterless text is `und` with score 0; a null id is held out; a null language is never learned
from; with no labelled document every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftmap.llm.graph import gathered, stored
from siftmap.llm.memory import returning
from siftmap.llm.wordhash import CASED, Words, chunks, mix, words

#: Documents of each language to learn from, about.
PER_LANGUAGE = 4000
ROUNDS = 3
#: Added to the expected count of every piece.
PRIOR = 0.05
UNDECIDED = "und"
STRETCH = 64
#: Words whose scores a worker remembers; then it starts afresh.
REMEMBERED = 200_000
#: Mass of a byte is scaled by this, so that products stay within floating point; taken off again in logarithms.
SCALE = 12.0

_MARK = "▁".encode()
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = 1 << 21


class Pieces:
    """The vocabulary as byte strings, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                names[bytes([int(sp.id_to_piece(i)[3:5], 16)])] = None
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names[sp.id_to_piece(i).encode()] = None
        for b in range(256):
            names.setdefault(bytes([b]), None)
        self.names = [n for n in names if len(n) <= STRETCH]
        self.longest = max(map(len, self.names))
        flat = np.frombuffer(b"".join(self.names), np.uint8)
        size = np.array([len(n) for n in self.names])
        start = np.cumsum(size) - size
        self.key = _spans(flat, start, start + size)
        slot = (self.key >> np.uint64(43)).astype(np.int64)
        self.first = np.full(_TABLE, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot) - 1, -1, -1)
        lost = np.flatnonzero(self.first[slot] != np.arange(len(slot)))
        second = ((self.key >> np.uint64(22)) & np.uint64(_TABLE - 1)).astype(np.int64)
        self.second = np.full(_TABLE, -1, np.int32)
        self.second[second[lost]] = lost
        left = lost[self.second[second[lost]] != lost]
        self.rest = {int(self.key[k]): int(k) for k in left}

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for none."""
        out = self.first[(key >> np.uint64(43)).astype(np.int64)]
        out = np.where((out >= 0) & (self.key[out] == key), out, -1)
        other = self.second[((key >> np.uint64(22)) & np.uint64(_TABLE - 1)).astype(np.int64)]
        out = np.where((out < 0) & (other >= 0) & (self.key[other] == key), other, out)
        if self.rest:
            for h, k in self.rest.items():
                out[key == np.uint64(h)] = k
        return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans by one running sum."""
    n = len(data)
    up = np.full(n + 1, _B, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n + 1, np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CASED.value[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Lattice:
    """All pieces at all places of many words; words are grouped by length so that one step serves all of them."""

    def __init__(self, pieces: Pieces, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        texts = [texts[i] for i in self.order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.base = np.cumsum(self.size) - self.size
        n = len(data)
        end_of = np.repeat(self.base + self.size, self.size)
        place = np.arange(n)
        self.piece = np.full((pieces.longest + 1, n), -1, np.int32)
        longest = int(min(pieces.longest, self.size.max() if len(size) else 0))
        up = np.full(n + 1, _B, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(n + 1, np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(CASED.value[data] * up[:n], out=total[1:])
        for k in range(1, longest + 1):
            at = place[place + k <= end_of]
            self.piece[k, at] = pieces.find(mix((total[at + k] - total[at]) * down[at] + np.uint64(k)))
        self.longest = longest
        self.bytes = n

    def _active(self, i: int) -> int:
        """Words of at least i bytes: the first so many."""
        return int(np.searchsorted(-self.size, -i, "right"))

    def forward(self, mass: np.ndarray) -> np.ndarray:
        """Scaled mass of each prefix: (bytes + words, languages), a word's prefixes from its base plus its number on."""
        w = len(self.size)
        alpha = np.zeros((self.bytes + w, mass.shape[1]))
        base = self.base + np.arange(w)
        alpha[base] = 1.0
        for i in range(1, int(self.size[0]) + 1 if w else 0):
            a = self._active(i)
            for k in range(1, min(i, self.longest) + 1):
                p = self.piece[k, self.base[:a] + i - k]
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    alpha[base[hit] + i] += alpha[base[hit] + i - k] * mass[p[hit]] * SCALE ** k
        return alpha

    def log_mass(self, mass: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability, in the order given."""
        alpha = self.forward(mass)
        w = len(self.size)
        last = np.log(np.maximum(alpha[self.base + np.arange(w) + self.size], 1e-300)) - (self.size * np.log(SCALE))[:, None]
        out = np.empty_like(last)
        out[self.order] = last
        return out

    def expected(self, mass: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over words seen `weight` times; one language."""
        alpha = self.forward(mass)[:, 0]
        w = len(self.size)
        base = self.base + np.arange(w)
        beta = np.zeros(len(alpha))
        total = np.maximum(alpha[base + self.size], 1e-300)
        beta[base + self.size] = weight[self.order] / total
        out = np.zeros(len(mass))
        for i in range(int(self.size[0]) if w else 0, 0, -1):
            a = self._active(i)
            for k in range(1, min(i, self.longest) + 1):
                p = self.piece[k, self.base[:a] + i - k]
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    m = mass[p[hit], 0] * SCALE ** k
                    after = beta[base[hit] + i]
                    beta[base[hit] + i - k] += m * after
                    out += np.bincount(p[hit], alpha[base[hit] + i - k] * m * after, len(out))
        return out


def stretches(word: bytes) -> list[bytes]:
    """A word with the vocabulary's mark of a word's start, in stretches that a lattice takes."""
    marked = _MARK + word
    return [marked[i:i + STRETCH] for i in range(0, len(marked), STRETCH)]


def _spell(w: Words, data: bytes, at: np.ndarray) -> list[bytes]:
    return [data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (bytes), n over all rows of (lang, text)."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pa.compute.equal(langs, lang))
                for chunk in chunks(texts):
                    w = words(chunk, CASED)
                    _, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                    spelt = _spell(w, chunk.data.tobytes(), at)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "word": pa.array(spelt, pa.binary()), "n": pa.array(n, pa.int64())})

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities (pieces, languages), from rows (doc_id, lang, text) that may be learned from.

    What reaches the driver is one number per piece and language.
    """
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = some.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = some.join(F.broadcast(sizes), "lang").where(share * F.col("rows") < per_language)
    # the sample is bounded, and so are its words
    counts = stored(gathered(word_counts(picked), 0), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    pieces = Pieces(vocabulary)
    size = np.array([len(n) for n in pieces.names])
    mass = np.repeat((0.02 ** size / (0.02 ** size).sum())[:, None], len(langs), axis=1)
    index = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        now = mass

        def run(batches):
            known = Pieces(vocabulary)
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                spoken = batch.column(0)
                for lang in spoken.unique().to_pylist():
                    own = batch.filter(pa.compute.equal(spoken, lang))
                    n = own.column(2).to_pylist()
                    texts, weight = [], []
                    for word, k in zip(own.column(1).to_pylist(), n):
                        for s in stretches(word):
                            texts.append(s)
                            weight.append(k)
                    for i in range(0, len(texts), 20_000):
                        more = Lattice(known, texts[i:i + 20_000]).expected(now[:, [index[lang]]], np.array(weight[i:i + 20_000], float))
                        total[lang] = total.get(lang, 0) + more
            for lang, seen in total.items():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at, pa.int64()), "seen": pa.array(seen[at])})

        seen = counts.mapInArrow(run, "lang string, piece bigint, seen double").groupBy("lang", "piece").agg(F.sum("seen").alias("seen")).toArrow()
        mass = np.full((len(pieces.names), len(langs)), prior)
        at = np.array([index[v] for v in seen.column("lang").to_pylist()], np.int64)
        np.add.at(mass, (seen.column("piece").to_numpy(), at), seen.column("seen").to_numpy())
        mass /= mass.sum(axis=0)
    return langs, mass


class _Scorer:
    def __init__(self, vocabulary: str, mass: np.ndarray):
        self.pieces, self.mass = Pieces(vocabulary), mass
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.table = np.zeros((1 << 16, self.mass.shape[1]))

    def learn(self, hashes: list[int], spelt: list[bytes]) -> None:
        for i in range(0, len(spelt), 10_000):
            texts, owner = [], []
            for k, word in enumerate(spelt[i:i + 10_000]):
                for s in stretches(word):
                    texts.append(s)
                    owner.append(k)
            scores = np.zeros((len(spelt[i:i + 10_000]), self.mass.shape[1]))
            np.add.at(scores, np.array(owner), Lattice(self.pieces, texts).log_mass(self.mass))
            while len(self.known) + len(scores) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            n = len(self.known)
            self.table[n:n + len(scores)] = scores
            self.known.update(zip(hashes[i:i + 10_000], range(n, n + len(scores))))

    def score(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, log probability of each text under each language, and bytes of its words."""
        for chunk in chunks(column):
            w = words(chunk, CASED)
            if len(self.known) > REMEMBERED:
                self.forget()
            distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            keys = distinct.tolist()
            new = [k for k, h in enumerate(keys) if h not in self.known]
            if new:
                self.learn([keys[k] for k in new], _spell(w, chunk.data.tobytes(), at[new]))
            slot = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))
            texts = len(chunk.offsets) - 1
            out, size = np.zeros((texts, self.mass.shape[1])), np.zeros(texts)
            if len(w.hash):
                full = np.flatnonzero(np.diff(w.bounds))
                heads = w.bounds[:-1][full]
                out[full] = np.add.reduceat(self.table[slot[back]], heads, axis=0)
                size[full] = np.add.reduceat((w.end - w.start).astype(float) + len(_MARK), heads)
            yield chunk.first, out, size


def _lettered(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    found = pa.compute.match_substring_regex(column, r"\p{L}")
    return found.fill_null(False).to_numpy(zero_copy_only=False)


def _judged(vocabulary: str, langs: list[str], mass: np.ndarray, batches, text: int):
    """Each batch with its predictions: language, its share, its negative log probability per byte."""
    scorer = _Scorer(vocabulary, mass) if langs else None
    for batch in batches:
        n = len(batch)
        best, share, nats = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.nan)
        known = _lettered(batch.column(text)) if langs else np.zeros(n, bool)
        for first, log, size in scorer.score(batch.column(text)) if langs else ():
            at = slice(first, first + len(log))
            best[at] = log.argmax(axis=1)
            top = log.max(axis=1)
            share[at] = 1.0 / np.exp(log - top[:, None]).sum(axis=1)
            nats[at] = -top / np.maximum(size, 1)
        yield batch, known, best, np.where(known, share, 0.0), nats


def predict(docs: DataFrame, vocabulary: str, langs: list[str], mass: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (share of the likeliest language), nats_per_byte (its log probability, lower is better known) per row."""

    def run(batches):
        for batch, known, best, share, nats in _judged(vocabulary, langs, mass, batches, 1):
            pred = [langs[b] if k else UNDECIDED for b, k in zip(best, known)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(share), "nats_per_byte": pa.array(nats, mask=~known)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, nats_per_byte double")


def keep(docs: DataFrame, vocabulary: str, langs: list[str], mass: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text is in some language with more than the share `least`. Nothing is shuffled."""
    text = docs.columns.index("text")

    def run(batches):
        for batch, known, _, share, _ in _judged(vocabulary, langs, mass, batches, text):
            yield batch.filter(pa.array(known & (share > least)))

    return docs.mapInArrow(returning(run), StructType([StructField(f.name, f.dataType) for f in docs.schema]))


def held_out(column: str = "doc_id"):
    """Documents kept from learning: a fifth by CRC-32 of the id, and null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the labelled documents that are not held out, then scores every document."""
    docs = docs.select("doc_id", "text", "lang")
    langs, mass = fit(docs.where(~held_out()), vocabulary, per_language, rounds)
    return predict(docs, vocabulary, langs, mass)
