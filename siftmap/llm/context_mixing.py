"""Language-model scores by online logistic mixing of hashed contexts.

A text is a row of words and an end. The most frequent training words, none seen once only, have binary codes of a Huffman tree; any other word is an escape code
and the codes of its bytes, of a tree of their own. Every bit is predicted:

1. Three predictors look up what training texts had at hashed contexts: the place in the tree alone, with one word before, with two words
   before; within a spelt word with one, two and three bytes before. Their counts are gathered from all training documents by Spark,
   each task adding up tables of its own; the table grows with the corpus to 2^MOST_BITS counters, a bound that also bounds the broadcast.
2. Their log-odds are mixed with weights that a gate picks (kind of bit, and how much the longer contexts have seen). A document begins with
   weights learned beforehand and adapts its own every 2^STEP_BITS bits, by the gradient of the coding cost.
3. A refinement table maps the mixed probability to what was observed at such probabilities; the mean of both codes the bit.

Weights and refinement come from a fifth of the documents (FOLD), predicted from the other training documents only; the final counts hold
that fifth too. The score is log10 of the product over all bits; bits per byte is its size in base 2 over the text's bytes.

The unigram base needs exact counts of all words. Frequent words are resolved where the text is read, from a table of bounded size; only the
rest is shuffled to the counts, so no key of that join is hot.

Defined cases: null text is empty and costs its end; null ids are training documents; repeated rows are scored each, and count each; without
training documents every word is spelt and every bit costs one bit. Words are compared by 64-bit hash. Texts of more than CHUNK bytes are worked on
alone, in some hundred bytes a byte. Further columns of `docs`, whatever their names, are left alone.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.llm.wordhash import SPACED, chunks, mix, words

#: Words with a code of their own.
CODED = 1 << 16
#: Rarer words are spelt: they teach how new words look and how often they come.
LEAST_CODED = 2
#: Counters of a context table: as many as training tokens, in powers of two, between these.
LEAST_BITS, MOST_BITS = 16, 22
#: The table of tree places without context.
PLAIN_BITS = 18
#: Training documents with this remainder teach weights; remainder 1 is held out.
FOLD = 2
#: So many bits, in powers of two, lie between two changes of a document's weights; and how far a change goes.
STEP_BITS = 9
RATE = 0.4
ROUNDS = 1
#: What a context has counted is smoothed by this.
PRIOR = 0.3
CHUNK = 1 << 17
PIECE = 1 << 14
KINDS, LEVELS, INPUTS = 2, 4, 3
GATES = KINDS * LEVELS * LEVELS
#: Steps of the refinement table, over log-odds from -8 to 8.
CELLS = 33
END = 0x5851F42D4C957F2D
BLANK = 0x20
_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


class Codes(NamedTuple):
    """Frequent words: hashes in order, their training counts, codes and code lengths; those of the escape, and of each byte."""

    hash: np.ndarray
    n: np.ndarray
    code: np.ndarray
    size: np.ndarray
    escape: tuple[int, int]
    byte_code: np.ndarray
    byte_size: np.ndarray


class Model(NamedTuple):
    codes: Codes
    tables: list[np.ndarray]  # per predictor: log-odds in 1/512 above 3 bits that say how much was seen
    weights: np.ndarray  # gate, input
    refined: np.ndarray  # kind, cell: probability of a one


def _plain(model: Model) -> tuple:
    """What is broadcast: workers know numpy, not this module."""
    return tuple(model.codes), model.tables, model.weights, model.refined


def _whole(plain: tuple) -> Model:
    return Model(Codes(*plain[0]), *plain[1:])


def held_out(column: str = "doc_id"):
    """Documents kept from learning: those whose id has CRC-32 remainder 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def huffman(weights: list[int]) -> list[tuple[int, int]]:
    """Code and length for each weight, two at least."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = {}
    fresh = len(weights)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    done = {fresh - 1: (0, 0)}
    for k in range(fresh - 2, -1, -1):
        up, bit = parent[k]
        code, size = done[up]
        done[k] = (code << 1 | bit, size + 1)
    return [done[k] for k in range(len(weights))]


def word_counts(docs: DataFrame) -> DataFrame:
    """hash and n of the words of all texts, ends included; and n of each byte, with `byte` for `hash`."""

    def run(batches):
        for batch in batches:
            parts, letters = [], np.zeros(256, np.int64)
            for c in chunks(batch.column(0)):
                parts.append(words(c, SPACED).hash)
                letters += np.bincount(_FOLDED[c.data], minlength=256)
            found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            found, n = np.append(found, np.uint64(END)), np.append(n, len(batch))
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(found.view(np.int64)).take(pa.array([*range(len(found)), *[None] * 256], pa.int64())),
                "byte": pa.array([None] * len(found) + list(range(256)), pa.int32()), "n": pa.array(np.concatenate([n, letters]), pa.int64())})

    return docs.select("text").mapInArrow(run, "hash bigint, byte int, n bigint").groupBy("hash", "byte").agg(F.sum("n").alias("n"))


def _split(built: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([c for c, _ in built], np.uint64), np.array([n for _, n in built], np.int64)


def codes_of(counts: DataFrame, total: int, letters: dict[int, int], coded: int = CODED) -> Codes:
    """Codes of the most frequent words; at most `coded` rows reach the driver."""
    top = counts.where(F.col("n") >= LEAST_CODED).orderBy(F.desc("n"), "hash").limit(coded).toArrow()
    known = dict(zip(top.column("hash").to_numpy().view(np.uint64).tolist(), top.column("n").to_pylist()))
    left = total - sum(known.values())
    known.setdefault(END, 0)
    names = sorted(known)
    built = huffman([max(1, known[h]) for h in names] + [max(1, left)])
    return Codes(np.array(names, np.uint64), np.array([known[h] for h in names], np.int64), *_split(built[:-1]), built[-1],
                 *_split(huffman([max(1, letters.get(b, 0)) for b in range(256)])))


class _Tokens(NamedTuple):
    hash: np.ndarray
    row: np.ndarray
    place: np.ndarray  # in the codes, -1 for none
    start: np.ndarray
    end: np.ndarray


def _tokens(chunk, codes: Codes) -> _Tokens:
    w = words(chunk, SPACED)
    texts = len(chunk.offsets) - 1
    n = len(w.hash) + texts
    at, last = np.arange(len(w.hash)) + w.row, w.bounds[1:] + np.arange(texts)
    digest, row, start, end = np.empty(n, np.uint64), np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    digest[at], row[at], start[at], end[at] = w.hash, w.row, w.start, w.end
    digest[last], row[last] = END, np.arange(texts)
    place = np.minimum(np.searchsorted(codes.hash, digest), len(codes.hash) - 1)
    return _Tokens(digest, row, np.where(codes.hash[place] == digest, place, -1), start, end)


class _Bits(NamedTuple):
    sizes: np.ndarray  # bits of each text
    bit: np.ndarray
    kind: np.ndarray
    slots: list[np.ndarray]


def _bits(chunk, t: _Tokens, codes: Codes, table_bits: int) -> _Bits:
    """All bits of a chunk in order, and where each predictor looks."""
    n = len(t.hash)
    first = np.ones(n, bool)
    first[1:] = t.row[1:] != t.row[:-1]
    one = np.empty(n, np.uint64)
    one[:1], one[1:] = 0, t.hash[:-1]
    one[first] = 0
    two = np.empty(n, np.uint64)
    two[:1], two[1:] = 0, one[:-1]
    two[first] = 0
    spelt = t.place < 0
    width = np.where(spelt, t.end - t.start + 1, 0)
    head = np.cumsum(1 + width) - (1 + width)
    symbols = n + int(width.sum())
    value, size = np.empty(symbols, np.uint64), np.empty(symbols, np.int64)
    value[head] = np.where(spelt, np.uint64(codes.escape[0]), codes.code[t.place])
    size[head] = np.where(spelt, codes.escape[1], codes.size[t.place])
    kind = np.ones(symbols, np.uint8)
    kind[head] = 0
    ctx = [np.zeros(symbols, np.uint64) for _ in range(3)]
    ctx[1][head] = mix(one + np.uint64(1))
    ctx[2][head] = mix(one * _ODD[1] + mix(two + np.uint64(2)))
    at = np.flatnonzero(spelt)
    if len(at):
        m = width[at]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        source, last = np.repeat(t.start[at], m) + inner, inner == np.repeat(m, m) - 1
        data = _FOLDED[chunk.data]
        letters = np.where(last, BLANK, data[np.minimum(source, len(data) - 1)])
        sym = np.repeat(head[at] + 1, m) + inner
        value[sym], size[sym] = codes.byte_code[letters], codes.byte_size[letters]
        before = []
        for back in (1, 2, 3):
            b = np.full(len(letters), BLANK, np.uint64)
            b[back:] = letters[:-back]
            b[inner < back] = BLANK
            before.append(b)
        a, b, c = before
        ctx[0][sym] = mix(a + np.uint64(1 << 40))
        ctx[1][sym] = mix(a + (b << np.uint64(8)) + np.uint64(1 << 41))
        ctx[2][sym] = mix(a + (b << np.uint64(8)) + (c << np.uint64(16)) + np.uint64(1 << 42))
    # a one before the code marks its length, so a shift leaves the place in the tree
    marked = np.repeat(value | (np.uint64(1) << size.view(np.uint64)), size)
    ends = np.cumsum(size)
    left = (np.repeat(ends, size) - np.arange(len(marked))).view(np.uint64)
    node = (marked >> left) * _ODD[0]
    slots = []
    for k in range(3):
        at = np.repeat(ctx[k], size)
        at ^= node
        at *= _ODD[k]
        at >>= np.uint64(64 - (PLAIN_BITS if k == 0 else table_bits))
        slots.append(at.view(np.int64))
    left -= np.uint64(1)
    marked >>= left
    marked &= np.uint64(1)
    texts = len(chunk.offsets) - 1
    last = np.concatenate([[0], ends])[np.concatenate([head, [symbols]])[np.searchsorted(t.row, np.arange(texts + 1))]]
    return _Bits(np.diff(last), marked.astype(np.uint8), np.repeat(kind, size), slots)


def _by_length(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    """The rows in order of their texts' bytes: a chunk takes as many steps as its longest text, so texts of like length share one."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0)
    return batch.take(pa.array(np.argsort(size.to_numpy(zero_copy_only=False), kind="stable")))


def _keep_freed_memory() -> None:
    """Freeing one large block makes the C library keep later ones of up to its size, instead of mapping each array's pages anew."""
    block = np.empty(31 << 20, np.uint8)
    del block


def _table_sizes(table_bits: int) -> list[int]:
    return [1 << PLAIN_BITS, 1 << table_bits, 1 << table_bits]


def context_counts(docs: DataFrame, codes: Codes, table_bits: int) -> DataFrame:
    """part (whether of FOLD), predictor, piece, counts of zeros and ones: what training documents had at each hashed context."""
    sizes = _table_sizes(table_bits)

    def run(batches):
        _keep_freed_memory()
        total = None
        for batch in batches:
            part = np.asarray(batch.column(1))
            for chunk in chunks(batch.column(0), CHUNK):
                b = _bits(chunk, _tokens(chunk, codes), codes, table_bits)
                if total is None:
                    total = [np.zeros((2, 2 * s), np.uint32) for s in sizes]
                own = part[chunk.first:chunk.first + len(b.sizes)].astype(np.int64)
                for table, at in zip(total, b.slots):
                    at <<= 1
                    at += b.bit
                    at += np.repeat(own * table.shape[1], b.sizes)
                    np.add.at(table.ravel(), at, np.uint32(1))
        for p in (0, 1) if total else ():
            for k, tables in enumerate(total):
                table = tables[p]
                for i in range(0, len(table), 2 * PIECE):
                    piece = table[i:i + 2 * PIECE]
                    if piece.any():
                        low, places, high = _narrow(piece)
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([p], pa.int32()), "predictor": pa.array([k], pa.int32()), "piece": pa.array([i // (2 * PIECE)], pa.int32()),
                            "low": pa.array([low], pa.binary()), "places": pa.array([places], pa.binary()), "high": pa.array([high], pa.binary())})

    part = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 5 == FOLD).cast("int"), F.lit(0))
    return docs.select("text", part).mapInArrow(run, "part int, predictor int, piece int, low binary, places binary, high binary")


def _narrow(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts in a nibble or a byte each, whichever is shorter in all, and the places and remainders of those above it."""
    best = None
    for most in (15, 255):
        places = np.flatnonzero(counts > most)
        size = len(counts) // (2 if most == 15 else 1) + 6 * len(places)
        if best is None or size < best[0]:
            best = size, most, places
    _, most, places = best
    low = np.minimum(counts, most).astype(np.uint8)
    if most == 15:
        low = low[::2] << 4 | low[1::2]
    return low.tobytes(), places.astype("<u2").tobytes(), (counts[places] - np.uint32(most)).astype("<u4").tobytes()


def _widen(low, places, high, size: int) -> np.ndarray:
    """The counts `_narrow` was given, `size` of them."""
    low = np.frombuffer(low, np.uint8)
    out = np.empty(size, np.int64)
    if len(low) < size:
        out[::2], out[1::2] = low >> 4, low & 15
    else:
        out[:] = low
    out[np.frombuffer(places, "<u2")] += np.frombuffer(high, "<u4")
    return out


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds in 1/512 and how much was seen, in 16 bits."""
    seen = zeros + ones
    level = np.digitize(seen, [1, 3, 16])
    odds = np.clip(np.round(np.log((ones + PRIOR) / (zeros + PRIOR)) * 512), -4095, 4095).astype(np.int64)
    return ((odds + 4096) << 3 | level).astype("<u2")


def _stretch(found: np.ndarray) -> np.ndarray:
    """The log-odds of `_odds`."""
    out = (found >> 3).astype(np.float32)
    out -= 4096
    out /= 512
    return out


def tables_of(counts: DataFrame, table_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Predictors without FOLD and with it, from `context_counts`."""

    def add(batches):
        own: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (part, k, piece), *blobs in zip(names, *(batch.column(k) for k in (3, 4, 5))):
                key = (k, piece, part)
                own[key] = own.get(key, 0) + _widen(*(b.as_buffer() for b in blobs), 2 * PIECE)
        for k, piece in sorted({key[:2] for key in own}):
            nothing = np.zeros(2 * PIECE, np.int64)
            without = own.get((k, piece, 0), nothing)
            both = without + own.get((k, piece, 1), nothing)
            out = [_odds(c[::2], c[1::2]).tobytes() for c in (without, both)]
            yield pa.RecordBatch.from_pydict({
                "predictor": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "without": pa.array(out[:1], pa.binary()), "both": pa.array(out[1:], pa.binary())})

    sizes = _table_sizes(table_bits)
    pieces = sum(max(1, s // PIECE) for s in sizes)
    rows = counts.repartition(max(1, pieces // 16), "predictor", "piece").mapInArrow(add, "predictor int, piece int, without binary, both binary").toArrow()
    empty = _odds(np.zeros(1), np.zeros(1))[0]
    out = tuple([np.full(max(s, PIECE), empty, "<u2") for s in sizes] for _ in range(2))
    for k, piece, *found in zip(*(rows.column(c).to_pylist() for c in range(4))):
        for tables, c in zip(out, found):
            tables[k][piece * PIECE:(piece + 1) * PIECE] = np.frombuffer(c, "<u2")
    return out


def plain_weights() -> np.ndarray:
    return np.full((GATES, INPUTS), 0.4)


def plain_refinement() -> np.ndarray:
    centre = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
    return np.repeat(centre[None, :], KINDS, axis=0)


class _Coded(NamedTuple):
    bits: np.ndarray  # cost per text
    used: np.ndarray  # text, gate: number of bits
    weights: np.ndarray  # text, gate, input: as they ended
    cell: np.ndarray  # per bit: kind * CELLS + nearest cell
    bit: np.ndarray


def _code(b: _Bits, model: Model, learning: bool = True) -> _Coded:
    """Codes the bits of a chunk; the same step of all its texts is one numpy step. `used` and `weights` are for learning only."""
    texts, width = len(b.sizes), 1 << STEP_BITS
    # runs of bits between two changes of weights, in the order of steps and then texts
    n_runs = (b.sizes + width - 1) >> STEP_BITS
    row = np.repeat(np.arange(texts), n_runs)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    order = np.argsort(step, kind="stable")
    row, step = row[order], step[order]
    size = np.minimum(b.sizes[row] - step * width, width)
    start = np.cumsum(size) - size
    source = np.repeat((np.cumsum(b.sizes) - b.sizes)[row] + step * width - start, size)
    source += np.arange(len(source))
    found = [t.take(s).take(source) for t, s in zip(model.tables, b.slots)]
    kind = b.kind.take(source)
    gate = (kind << 4) + ((found[1] & 7) << 2).astype(np.uint8) + (found[2] & 7).astype(np.uint8)
    own = np.repeat(row * GATES, size)
    own += gate
    x = [_stretch(f) for f in found]
    bit = b.bit.take(source).astype(np.float32)
    weights = [np.tile(w, texts) for w in model.weights.astype(np.float32).T]
    odds, p = np.empty(len(own), np.float32), np.empty(len(own), np.float32)
    heads = np.flatnonzero(np.diff(step, prepend=-1))
    bounds = [*start[heads].tolist(), len(own)]
    for low, high, base in zip(bounds, bounds[1:], (row[heads] * GATES).tolist()):
        at, some = own[low:high], [v[low:high] for v in x]
        dot = odds[low:high]
        np.multiply(weights[0].take(at), some[0], out=dot)
        for w, v in zip(weights[1:], some[1:]):
            dot += w.take(at) * v
        np.clip(dot, -12, 12, out=dot)
        guess = p[low:high]
        np.negative(dot, out=guess)
        np.exp(guess, out=guess)
        guess += 1
        np.reciprocal(guess, out=guess)
        error = bit[low:high] - guess
        # a step's first text has its smallest row, so a short step of a long text counts its own gates alone
        at = at - base
        scale = RATE / (np.bincount(at) + 32)
        for w, v in zip(weights, some):
            w[base:base + len(scale)] += scale * np.bincount(at, error * v)
    scaled = np.clip(odds, -8, 8)
    scaled *= (CELLS - 1) / 16
    scaled += (CELLS - 1) / 2
    cell = np.rint(scaled).astype(np.int64)
    cell += kind * np.int64(CELLS)
    p += model.refined.astype(np.float32).ravel().take(cell)
    p *= np.float32(0.5)
    cost = np.log(np.abs(1 - bit - p))
    cost = np.add.reduceat(cost, start, dtype=np.float64) if len(start) else np.zeros(0)
    bits = np.bincount(row, cost, texts) / -np.log(2)
    if not learning:
        return _Coded(bits, np.zeros(0), np.zeros(0), cell, bit)
    used = np.bincount(own, minlength=texts * GATES).reshape(texts, GATES)
    return _Coded(bits, used, np.stack(weights, axis=1).reshape(texts, GATES, INPUTS), cell, bit)


def learn(docs: DataFrame, model: Model, table_bits: int, rounds: int = ROUNDS) -> Model:
    """Weights: means of what the documents' own ended at, by bits; refinement: what was observed. A few hundred numbers reach the driver."""
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(_plain(model))

        def run(batches):
            _keep_freed_memory()
            now = _whole(sent.value)
            used, weights, seen = np.zeros(GATES), np.zeros((GATES, INPUTS)), np.zeros((2, KINDS * CELLS))
            for batch in batches:
                for chunk in chunks(_by_length(batch, 0).column(0), CHUNK):
                    c = _code(_bits(chunk, _tokens(chunk, now.codes), now.codes, table_bits), now)
                    used += c.used.sum(axis=0)
                    weights += (c.used[:, :, None] * c.weights).sum(axis=0)
                    for bit in (0, 1):
                        seen[bit] += np.bincount(c.cell[c.bit == bit], minlength=KINDS * CELLS)
            flat = np.concatenate([used, weights.ravel(), seen.ravel()])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(flat))), "v": pa.array(flat)})

        rows = docs.select("text").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(GATES + GATES * INPUTS + 2 * KINDS * CELLS)
        flat[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
        used, weights = flat[:GATES], flat[GATES:GATES * (1 + INPUTS)].reshape(GATES, INPUTS)
        zeros, ones = flat[GATES * (1 + INPUTS):].reshape(2, KINDS, CELLS)
        weights = (weights + 1000 * model.weights) / (used + 1000)[:, None]
        refined = (ones + 50 * plain_refinement()) / (zeros + ones + 50)
        model = model._replace(weights=weights, refined=refined)
    return model


def _table_bits(total: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, int(total).bit_length())))


def fit(train: DataFrame, coded: int = CODED) -> tuple[Model, DataFrame, int, int]:
    """The model, all word counts (hash, n), their sum and number, from rows (doc_id, text) to learn from."""
    gathered = stored(word_counts(train), "words")
    letters = dict(gathered.where("byte IS NOT NULL").select("byte", "n").collect())
    counts = gathered.where("byte IS NULL").select("hash", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    codes = codes_of(counts, total, letters, coded)
    bits = _table_bits(total)
    without, both = tables_of(context_counts(train, codes, bits), bits)
    fold = train.where(F.crc32(F.col("doc_id").cast("string")) % 5 == FOLD)
    model = learn(fold, Model(codes, without, plain_weights(), plain_refinement()), bits)
    return model._replace(tables=both), counts, total, distinct


def score(docs: DataFrame, model: Model, counts: DataFrame, total: int, distinct: int) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    sent = docs.sparkSession.sparkContext.broadcast(_plain(model))
    below = total + 0.5 * (distinct + 1)
    bits = _table_bits(total)

    def run(batches):
        _keep_freed_memory()
        now = _whole(sent.value)
        codes = now.codes
        known = codes.n > 0
        logs = np.log10((codes.n + 0.5) / below)
        for batch in batches:
            batch = _by_length(batch, 3)
            for chunk in chunks(batch.column(3), CHUNK):
                texts = len(chunk.offsets) - 1
                t = _tokens(chunk, codes)
                coded = _code(_bits(chunk, t, codes, bits), now, False)
                own = t.place >= 0
                place, row = t.place[own], t.row[own]
                base, n_known = np.bincount(row, logs[place], texts), np.bincount(row, known[place], texts)
                digest, row = t.hash[~own], t.row[~own]
                order = np.lexsort((digest, row))
                digest, row = digest[order], row[order]
                new = np.ones(len(digest), bool)
                new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                rare = pa.StructArray.from_arrays([pa.array(digest[at].view(np.int64)), pa.array(np.diff(np.r_[at, len(digest)]).astype(np.int64))], ["hash", "k"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(texts + 1)), pa.int32()), rare)
                size = np.diff(chunk.offsets)
                part = slice(chunk.first, chunk.first + texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[part] for k in range(3)] + [pa.array(np.bincount(t.row, minlength=texts)), pa.array(n_known.astype(np.int64)), pa.array(base), rare,
                     pa.array(-coded.bits * np.log10(2)), pa.array(coded.bits / np.maximum(size, 1))],
                    ["at", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare", "score", "bits_per_byte"])

    rows = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", held_out().alias("held_out"), "text")
    schema = "at bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, rare array<struct<hash bigint, k bigint>>, score double, bits_per_byte double"
    scored = stored(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("at", F.inline("rare")).join(counts, "hash")
    more = F.sum(F.col("k") * (F.log10((F.col("n") + 0.5) / below) - F.log10(F.lit(0.5) / below)))
    rare = rare.groupBy("at").agg(F.sum("k").alias("more_known"), more.alias("more_base"))
    unknown = F.aggregate("rare", F.lit(0).cast("bigint"), lambda s, r: s + r["k"])
    return scored.withColumn("n_rare", unknown).drop("rare").join(rare, "at", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.col("n_rare") * F.log10(F.lit(0.5) / below) + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")


def audit(docs: DataFrame, coded: int = CODED) -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    docs = docs.select("doc_id", "text")
    return score(docs, *fit(docs.where(~held_out()), coded))
