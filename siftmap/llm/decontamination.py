"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

For every benchmark item, windows of as many words as the item has are fingerprinted with 64 bits summed over their weighted
5-word shingles. Fingerprints are cut into 8 blocks; by the pigeonhole principle two fingerprints within `RADIUS` bits agree in
some block up to RADIUS // 8 bits, so looking a window's blocks up in an index of the items' blocks and their near values finds
every item within the radius. Each such candidate is decided by the exact weighted Jaccard similarity of the two shingle sets.
A window with no shingle of an item of its size has similarity 0 with all of them, so only windows around shared shingles are
formed: every window that can reach the threshold is among them.

A shingle weighs log(1 + items / items that hold it); one that no item holds weighs as one that a single item holds.
Words are runs of letters and digits (and anything beyond ASCII), in lower case.

The benchmark is sent to the tasks in slices of at most `SLICE_BYTES` of text; a larger one takes further passes over the
documents, with the same result.

Defined cases: null and empty texts hold nothing; items of fewer than 5 words are too short to tell a leak from chance and are
not searched; items with equal texts are all reported; a null doc_id or item_id is kept as null; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftmap.llm.memory import returning
from siftmap.llm.wordhash import ALNUM, chunks, mix, shingles, words

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 20
SLICE_BYTES = 32 << 20


def _near(radius: int) -> list[int]:
    """All 8-bit masks of at most `radius` ones."""
    return [m for m in range(256) if m.bit_count() <= radius]


def fingerprints(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from start to end, given running sums of their signed weights per bit."""
    ones = (prefix[end] - prefix[start]) > 0
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]


def running(grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums per bit of +weight where the shingle's hash has the bit, else -weight."""
    spread = mix(grams ^ np.uint64(0x2545F4914F6CDD1D))
    bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    out = np.zeros((len(grams) + 1, 64))
    np.cumsum((2 * bits - 1) * weight[:, None], axis=0, out=out[1:])
    return out


class Index:
    """Items by size, with their shingles, fingerprints and the multi-index of the fingerprints' blocks."""

    def __init__(self, items: list[tuple[int | None, str]], items_in_all: int, held: dict[int, int], radius: int = RADIUS):
        self.ids = [i for i, _ in items]
        column = pa.compute.utf8_lower(pa.array([t or "" for _, t in items], pa.string()))
        grams = []
        for chunk in chunks(column):
            w = words(chunk, ALNUM)
            g, at = shingles(w, SHINGLE)
            row = w.row[at]
            cut = np.searchsorted(row, np.arange(len(chunk.offsets)))
            grams += [g[cut[k]:cut[k + 1]] for k in range(len(chunk.offsets) - 1)]
        self.other = float(np.log1p(items_in_all))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.weight = np.log1p(items_in_all / np.array([held.get(int(h), 1) for h in self.known.view(np.int64)], float))
        self.sets = [np.unique(g) for g in grams]
        self.total = np.array([self.weigh(s).sum() for s in self.sets])
        self.size = np.array([len(g) + SHINGLE - 1 if len(g) else 0 for g in grams], np.int64)
        prints = [fingerprints(running(g, self.weigh(g)), np.array([0]), np.array([len(g)]))[0] if len(g) else np.uint64(0) for g in grams]
        self.print = np.array(prints, np.uint64)
        self.sizes: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        masks = np.array(_near(radius // BLOCKS), np.int64)
        for n in np.unique(self.size[self.size > 0]):
            of = np.flatnonzero(self.size == n)
            tables = []
            for b in range(BLOCKS):
                value = ((self.print[of] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
                slot = (value[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(slot, kind="stable")
                tables.append((np.searchsorted(slot[order], np.arange(257)), np.repeat(of, len(masks))[order]))
            self.sizes[int(n)] = (np.unique(np.concatenate([self.sets[k] for k in of])), tables)
        self.radius = radius

    def place(self, grams: np.ndarray) -> np.ndarray:
        """Position in `known`, -1 for others."""
        if not len(self.known):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, at, -1)

    def weigh(self, grams: np.ndarray) -> np.ndarray:
        at = self.place(grams)
        return np.where(at >= 0, self.weight[at], self.other) if len(self.known) else np.full(len(grams), self.other)

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items of n words within the radius of them, and the distances."""
        wins, items = [], []
        for b, (cut, of) in enumerate(self.sizes[n][1]):
            value = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            count = cut[value + 1] - cut[value]
            wins.append(np.repeat(np.arange(len(prints)), count))
            items.append(of[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(cut[value], count)])
        pair = np.unique(np.concatenate(wins) * len(self.ids) + np.concatenate(items))
        win, item = pair // len(self.ids), pair % len(self.ids)
        far = np.bitwise_count(prints[win] ^ self.print[item])
        keep = far <= self.radius
        return win[keep], item[keep], far[keep]

    def search(self, grams: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of the matches in one text; `shared`: shingles that some item has."""
        anchors = np.flatnonzero(shared)
        if not len(anchors):
            return []
        prefix, out = running(grams, self.weigh(grams)), []
        for n, (own, _) in self.sizes.items():
            at = anchors[np.isin(grams[anchors], own)]
            long = n - SHINGLE + 1
            if not len(at) or long > len(grams):
                continue
            edge = np.zeros(len(grams) + 2, np.int64)
            np.add.at(edge, np.maximum(at - long + 1, 0), 1)
            np.add.at(edge, at + 1, -1)
            start = np.flatnonzero(np.cumsum(edge[:len(grams) - long + 1]) > 0)
            if not len(start):
                continue
            win, item, far = self.near(n, fingerprints(prefix, start, start + long))
            hits = []
            for w, i, d in zip(win.tolist(), item.tolist(), far.tolist()):
                window = np.unique(grams[start[w]:start[w] + long])
                both = self.weigh(np.intersect1d(window, self.sets[i], assume_unique=True)).sum()
                alike = both / (self.weigh(window).sum() + self.total[i] - both)
                if alike >= SIMILARITY - 1e-12:
                    hits.append((-alike, int(start[w]), i, d))
            taken: dict[int, list[int]] = {}
            for alike, s, i, d in sorted(hits):
                if all(abs(s - t) >= n for t in taken.setdefault(i, [])):
                    taken[i].append(s)
                    out.append((i, s, n, d, -alike))
        return sorted(out)


def _indexes(bench: DataFrame, slice_bytes: int) -> Iterator[Index]:
    """The benchmark in slices that the driver and the tasks can hold."""
    items = bench.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = items.count()
    slices = max(1, -(-size // slice_bytes))

    def grams(batches):
        for batch in batches:
            for chunk in chunks(pa.compute.utf8_lower(batch.column(0))):
                w = words(chunk, ALNUM)
                g, at = shingles(w, SHINGLE)
                pair = np.unique(np.stack([w.row[at].astype(np.uint64), g]), axis=1)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(pair[1].view(np.int64))})

    held = items.select("text").mapInArrow(grams, "gram bigint").groupBy("gram").count().where("count > 1")
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    for k in range(slices):
        some = [(r.item_id, r.text) for r in items.where(dealt == k).collect()]
        if slices == 1:
            counts = {r[0]: r[1] for r in held.collect()}
        else:
            own = items.where(dealt == k).select("text").mapInArrow(grams, "gram bigint").distinct()
            counts = {r[0]: r[1] for r in held.join(own, "gram").collect()}
        yield Index(some, count, counts)


def _matches(index: Index, column: pa.Array) -> Iterator[tuple[int, list]]:
    """Row and matches of each text that has some."""
    for chunk in chunks(pa.compute.utf8_lower(column)):
        w = words(chunk, ALNUM)
        grams, at = shingles(w, SHINGLE)
        shared = index.place(grams) >= 0
        row = w.row[at]
        for k in np.unique(row[shared]):
            a, b = np.searchsorted(row, [k, k + 1])
            found = index.search(grams[a:b], shared[a:b])
            if found:
                yield chunk.first + int(k), found


def matches(docs: DataFrame, bench: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity of every benchmark item found in `docs` (doc_id, text)."""
    out = None
    for index in _indexes(bench, slice_bytes):

        def run(batches, index=index):
            for batch in batches:
                rows, cols = [], ([], [], [], [], [])
                for r, found in _matches(index, batch.column(1)):
                    for i, start, n, far, alike in found:
                        rows.append(r)
                        for c, v in zip(cols, (index.ids[i], start, n, far, float(alike))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, hamming int, similarity double")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without those that hold a benchmark item. Rows stay where they are: nothing is shuffled."""
    text = docs.columns.index("text")
    for index in _indexes(bench, slice_bytes):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, _ in _matches(index, batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(returning(run), StructType([StructField(f.name, f.dataType) for f in docs.schema]))
    return docs

