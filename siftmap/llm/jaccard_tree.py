"""N-gram Jaccard join by signature trees.

Two texts link when their sets of word n-grams have a Jaccard similarity of at least percent/100. No link is lost:

1. Each set is cut by hash into parts, more parts than two linked sets can differ in; so linked sets agree on several whole parts.
   Each looks only by as many parts as two linked sets can differ in, and one more, those that say most: with the most n-grams that few texts hold. As both order
   their parts alike, linked sets still agree on one; a few n-grams, or a passage or line shared by many texts, hardly ever form a family.
   Parts agreed on give candidate families; parts meet in buckets, each batch sending a part once.
2. A larger family is cut by classes of set size, and by hash within a class, into blocks of bounded numbers of texts and n-grams. Each pair of blocks whose
   size ranges allow a link is one task group: a signature tree over each block holds OR-combined token bitmaps and size
   ranges, a dual traversal drops node pairs whose largest possible overlap is too small, and exact overlaps decide the rest.
   Families of several blocks go through the trees twice: first with bitmaps alone, whose possible links split them into smaller
   families, then with the texts that are left.
3. Links are counted per text and become components. Texts with equal sets are one class from the start, and linked to each other. A
   task group returns the counts and, of its links, as many as tie its texts together; links() returns them all.

Defined cases: a null or blank text has an empty set and links with nothing; a text of fewer than n words has its whole word
sequence as the one n-gram; repeated rows are reported once per row; a null doc_id is reported as null with the component of its class; n_links counts the
other rows that a row links with, those with an equal set included. N-grams are compared by 64-bit hash, sets of equal texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import WIDE_ROWS, components, gathered, stored
from siftmap.llm.memory import returning, returning_group
from siftmap.llm.wordhash import SPACED, chunks, mix, shingles, whole, words

PERCENT = 85
SIZE = 4
#: Texts and n-grams of a block: the memory of one task group, not its result.
BLOCK_TEXTS = 1024
BLOCK_GRAMS = 1 << 20
#: Set sizes from CLASS^k on may share a block of a large family.
CLASS = 1.05
#: Set sizes from BAND^k on share the number of parts.
BAND = 1.1
#: Parts beyond those that two linked sets can differ in, as a share of these: more of them leave more choice among smaller parts.
SPARE = 0.4
BITS = 4096
#: Bitmaps that split large families: bits for each n-gram, and the widest bitmap; a larger set's says less, and loses no link.
LOAD = 4
MOST_BITS = 1 << 16
#: Hash classes in which n-grams are counted to tell common ones.
COUNTERS = 1 << 20
#: Parts that one bucket holds on average: the memory of a task group; the number of buckets grows with the input.
BUCKET_PARTS = 1 << 20
#: Parts that a mapping task holds before it sends them: its memory; a part is sent once for each such group of sets.
HELD_PARTS = 1 << 19
#: The lower six bytes of a set's hash name its node in the search for families; sets that share them share a family.
KEY = np.uint64((1 << 48) - 1)
#: Edges of a set in the search for families, about; wrong, it only makes the first round's partitions larger or smaller.
EDGES = 4
TILES = "array<struct<fam bigint, i bigint, j bigint, side int>>"
LEAF = 8
FAN = 4


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: first row, sorted distinct n-gram hashes of all texts, and their bounds per text."""
    for chunk in chunks(column):
        w = words(chunk, SPACED)
        texts = len(chunk.offsets) - 1
        grams, at = shingles(w, size)
        rows = w.row[at]
        count = np.diff(w.bounds)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            grams = np.concatenate([grams, whole(w)[short]])
            rows = np.concatenate([rows, short])
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[new], rows[new]
        yield chunk.first, grams, np.searchsorted(rows, np.arange(texts + 1))


def _bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, parts, sent) under which a set of n looks for partners: the bands that the smaller set of a link may be in.

    Linked sets differ in fewer than `sent` parts. So of all their parts, in any one order that goes by what a part holds, the first
    `sent` of either set have one in common.
    """
    out = []
    k = 0
    low = 1
    while low <= n:
        high = max(low + 1, int(np.ceil(BAND ** (k + 1))))
        if high - 1 >= -(-n * percent // 100):
            differ = (high - 1) * (100 - percent) // percent
            spare = 3 + int(np.ceil(SPARE * differ)) if differ else 0
            out.append((k, differ + 1 + spare, differ + 1))
        low, k = high, k + 1
    return out


def _parts(grams: np.ndarray, common: np.ndarray | None, percent: int) -> np.ndarray:
    """Signatures of the parts by which one set looks for partners: those with the most n-grams that are not common, then with the most n-grams."""
    out = []
    hashed = mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    place, mixed = hashed >> np.uint64(16), mix(grams)
    light = None if common is None else ~common[(hashed % np.uint64(len(common))).astype(np.int64)]
    for band, parts, sent in _bands(len(grams), percent):
        part = (place % np.uint64(parts)).astype(np.int64)
        size = np.bincount(part, minlength=parts)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[np.argsort(part, kind="stable")], dtype=np.uint64)])
        end = np.cumsum(size)
        total = mix(running[end] - running[end - size] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)))
        says = size if light is None else np.bincount(part[light], minlength=parts)
        out.append(total[np.lexsort((total, -size, -says))[:sent]])
    return np.concatenate(out).view(np.int64)


def common_grams(docs: DataFrame, size: int = SIZE, counters: int = COUNTERS) -> np.ndarray:
    """Which of `counters` hash classes hold n-grams of very many texts: far above the mean of a count over all documents.

    The counts are added up by Spark in pieces; their number is fixed. What is called common changes the work, never the links.
    """
    step = 1 << 15

    def count(batches):
        total = np.zeros(counters, "<u4")
        for batch in batches:
            for _, grams, _ in _sets(batch.column(0), size):
                at, n = np.unique(mix(grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(counters), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        for k in range(0, counters, step):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "counts": pa.array([total[k:k + step].tobytes()], pa.binary())})

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                own[k] = own.get(k, 0) + np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)
        for k, c in own.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "counts": pa.array([c.astype("<i8").tobytes()], pa.binary())})

    pieces = docs.select("text").mapInArrow(returning(count), "piece bigint, counts binary")
    rows = pieces.repartition(counters // step, "piece").mapInArrow(add, "piece bigint, counts binary").toArrow()
    total = np.zeros(counters, np.int64)
    for k, c in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        total[k:k + step] = np.frombuffer(c, "<i8")
    mean = total.mean()
    return total > 64 + mean + 12 * np.sqrt(mean)


def _signature(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0, 0xA0761D6478BD642F):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ np.uint64(salt)), out=total[1:])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
    return out[0], out[1]


def _bitmap(grams: np.ndarray) -> bytes:
    """Bits of the n-grams' hashes: a power of two of them, at least LOAD for each n-gram, at most MOST_BITS."""
    width = min(max(64, 1 << int(LOAD * len(grams) - 1).bit_length()), MOST_BITS)
    out = np.zeros(width, bool)
    out[(mix(grams) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of `width` bytes: a wider one's stretches are OR-combined."""
    out = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in bits])
    return out.view("<u8")


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, sig (128 bits of the set; null if empty), key (48 of them), text_key (a hash of the text), bits (bitmap of the set)."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            counts = np.zeros(n, np.int64)
            sigs, keys, bits = [None] * n, [None] * n, [None] * n
            for first, grams, bounds in _sets(batch.column(1), size):
                low, high = _signature(grams, bounds)
                own = np.diff(bounds)
                counts[first:first + len(own)] = own
                for k in np.flatnonzero(own).tolist():
                    sigs[first + k] = high[k].tobytes() + low[k].tobytes()
                    keys[first + k] = int(low[k] & KEY)
                    bits[first + k] = _bitmap(grams[bounds[k]:bounds[k + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(sigs, pa.binary()), pa.array(keys, pa.int64()), batch.column(2), pa.array(bits, pa.binary())],
                ["doc_id", "n_shingles", "sig", "key", "text_key", "bits"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(returning(run), "doc_id bigint, n_shingles bigint, sig binary, key bigint, text_key bigint, bits binary")


def _stars(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of parts and the sets holding them: the distinct edges (set, least set of a part) as two arrays, and the first entry of each part."""
    order = np.lexsort((key, part))
    part = part[order]
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    del part
    first = order[new]
    key = key[order]
    del order
    # entries that are not the first of their part, in order; only these can be far from the least set
    rest = np.flatnonzero(~new)
    far, least = key[rest], key[new][np.searchsorted(np.flatnonzero(new), rest, "right") - 1]
    keep = far != least
    pairs = np.unique(np.stack([far[keep], least[keep]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], first


def _six(values: np.ndarray) -> bytes:
    """The lower six bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def part_edges(docs: DataFrame, size: int, percent: int, buckets: int, common: np.ndarray | None = None) -> DataFrame:
    """Edges key, least between sets that agree on a part; `key` is the set's key without its upper two bytes.

    A batch ties the sets it holds itself, up to HELD_PARTS parts of them at a time, and sends each part once for these, with its least set. Parts
    travel in blobs of six bytes each, by set and bucket; the hashes are stored nowhere else. What six bytes confuse is an edge too many,
    never one too few.
    """
    packed = None if common is None else np.packbits(common)

    def blobs_of(keys: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        """What is sent of these sets; empties the lists."""
        key, part = np.concatenate(keys), np.concatenate(parts)
        keys.clear()
        parts.clear()
        a, b, first = _stars(part, key)
        key, part = key[first], part[first]
        bucket = part % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, part, bucket = key[order], part[order] // np.uint64(buckets), bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = {"bucket": bucket[cuts].astype(np.int64).tolist(), "sets": [], "counts": [], "parts": [], "a": [], "b": []}
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            own, n = np.unique(key[i:j], return_counts=True)
            out["sets"].append(_six(own))
            out["counts"].append(n.astype("<u2" if n.max() < 1 << 16 else "<u4").tobytes())
            out["parts"].append(_six(part[i:j]))
        out["a"], out["b"] = [b""] * len(cuts), [b""] * len(cuts)
        home = a % np.uint64(buckets)
        for h in np.unique(home).tolist():
            at = home == h
            out["bucket"].append(int(h))
            for c, v in (("sets", b""), ("counts", b""), ("parts", b""), ("a", _six(a[at])), ("b", _six(b[at]))):
                out[c].append(v)
        types = {"bucket": pa.int64()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.binary())) for c, v in out.items()})

    def run(batches):
        often = None if packed is None else np.unpackbits(packed).view(bool)
        for batch in batches:
            seen = set()
            keys, parts, held = [], [], 0
            for _, grams, bounds in _sets(batch.column(0), size):
                low, _ = _signature(grams, bounds)
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    if int(low[k]) not in seen:
                        seen.add(int(low[k]))
                        parts.append(_parts(grams[bounds[k]:bounds[k + 1]], often, percent).view(np.uint64))
                        keys.append(np.full(len(parts[-1]), low[k] & KEY, np.uint64))
                        held += len(parts[-1])
                        if held >= HELD_PARTS:
                            yield blobs_of(keys, parts)
                            keys, parts, held = [], [], 0
            if held:
                yield blobs_of(keys, parts)

    def tie(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("sets", "counts", "parts", "a", "b")}
        keys = []
        for s, c in zip(col["sets"], col["counts"]):
            n = np.frombuffer(c, "<u2" if 3 * len(c) == len(s) else "<u4").astype(np.int64)
            keys.append(np.repeat(_from_six(s), n))
        keys = np.concatenate(keys)
        a, b, _ = _stars(_from_six(b"".join(col.pop("parts"))), keys)
        both = np.stack([np.concatenate([a, _from_six(b"".join(col["a"]))]), np.concatenate([b, _from_six(b"".join(col["b"]))])], axis=1)
        both = np.unique(both, axis=0).astype(np.int64)
        return pa.table({"key": pa.array(both[:, 0]), "least": pa.array(both[:, 1])})

    blobs = docs.select("text").mapInArrow(returning(run), "bucket bigint, sets binary, counts binary, parts binary, a binary, b binary")
    return blobs.groupBy("bucket").applyInArrow(returning_group(tie), "key bigint, least bigint")


def _with_sets(docs: DataFrame, size: int) -> DataFrame:
    """Text, sig, copies and tiles of rows whose text has the set `sig`; a set comes once in a batch, and texts without it (a clash of text hashes) go."""

    def run(batches):
        for batch in batches:
            first = {s: k for k, s in reversed(list(enumerate(batch.column(1).to_pylist())))}
            batch = batch.take(pa.array(sorted(first.values()), pa.int64()))
            right = []
            want = batch.column(1)
            for first, grams, bounds in _sets(batch.column(0), size):
                low, high = _signature(grams, bounds)
                right += [want[first + k].as_py() == high[k].tobytes() + low[k].tobytes() for k in range(len(low))]
            yield batch.filter(pa.array(right, pa.bool_()))

    return docs.select("text", "sig", "copies", "tiles").mapInArrow(returning(run), f"text string, sig binary, copies bigint, tiles {TILES}")


class _Tree:
    """Levels of nodes over texts in order of size: OR-combined bitmaps, size ranges, most grams beyond the bitmap's ones."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        slack = sizes - _ones(bitmaps)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            maps, low, high, loose = self.levels[-1]
            first = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(loose, first)))
            width = FAN

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `node` repeated for each child, and the children one level down."""
        width = LEAF if level == 1 else FAN
        below = len(self.levels[level - 1][1])
        first = node * width
        count = np.minimum(first + width, below) - first
        at = np.repeat(np.arange(len(node)), count)
        return at, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[at]


def _ones(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)


def _possible(a: _Tree, la: int, x: np.ndarray, b: _Tree, lb: int, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether some text below x can link with one below y, by size ranges and the largest possible overlap."""
    ma, lowa, higha, sa = (v[x] for v in a.levels[la])
    mb, lowb, highb, sb = (v[y] for v in b.levels[lb])
    keep = (100 * higha >= percent * lowb) & (100 * highb >= percent * lowa)
    need = -(-percent * (lowa + lowb) // (100 + percent))
    at = np.flatnonzero(keep)
    for i in range(0, len(at), 1 << 14):
        part = at[i:i + (1 << 14)]
        most = _ones(ma[part] & mb[part]) + np.minimum(sa[part], sb[part])
        keep[part] = most >= need[part]
    return keep


def _candidates(a: _Tree, b: _Tree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that a dual traversal can't rule out."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(a, la, x, b, lb, y, percent)
        x, y = x[keep], y[keep]
        if la == 0 and lb == 0:
            return (x[x < y], y[x < y]) if same else (x, y)
        if la >= lb:
            at, down = a.children(la, x)
            x, y, la = down, y[at], la - 1
            if same and lb > la:
                at, down = b.children(lb, y)
                x, y, lb = x[at], down, lb - 1
        else:
            at, down = b.children(lb, y)
            x, y, lb = x[at], down, lb - 1
        if same:
            keep = x <= y
            x, y = x[keep], y[keep]


def _links(sides: list[tuple[np.ndarray, np.ndarray]], percent: int) -> np.ndarray:
    """All links between texts of one block, or of two: rows of two positions counted through both.

    `sides`: for each block flat n-grams and bounds.
    """
    flats = np.concatenate([f for f, _ in sides])
    _, ids = np.unique(flats, return_inverse=True)
    starts, sizes, trees, ranks = [], [], [], []
    before = shift = 0
    for flat, bounds in sides:
        n = np.diff(bounds)
        bits = np.zeros((len(n), BITS // 64), np.uint64)
        slot = (mix(flat.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        np.bitwise_or.at(bits, (row, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        order = np.lexsort((np.arange(len(n)), n))
        trees.append(_Tree(bits[order], n[order]))
        ranks.append(order + before)
        starts.append(bounds[:-1] + shift)
        sizes.append(n)
        before += len(n)
        shift += len(flat)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    same = len(sides) == 1
    x, y = _candidates(trees[0], trees[-1], same, percent)
    x, y = ranks[0][x], ranks[-1][y]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    flag = np.zeros(len(ids) + 1, np.int64)
    out = []
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
    for h, t in zip(heads, [*heads[1:], len(x)]):
        i = x[h]
        own = ids[start[i]:start[i] + size[i]]
        flag[own] = 1
        for k in range(h, t, 64):
            some = y[k:min(k + 64, t)]
            n = size[some]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)
            both = np.add.reduceat(flag[ids[at]], np.cumsum(n) - n)
            linked = some[100 * both >= percent * (size[i] + n - both)]
            out.append(np.stack([np.full(len(linked), i), linked], axis=1))
        flag[own] = 0
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of these pairs of n texts ties two groups that the pairs before it leave apart."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros(len(pairs), bool)
    apart = n - 1
    for k, (i, j) in enumerate(pairs.tolist()):
        p, q = find(i), find(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out[k] = True
            apart -= 1
            if not apart:
                break
    return out


def _tile(size: int, percent: int, every: bool):
    """Pairs a, b of a task group's texts: all links; or, unless `every`, a forest of them with n null, and for each text a with links
    how many rows n it is linked to, with b null."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sigs = table.column("sig").to_pylist()
        copies = table.column("copies").to_numpy()
        texts = table.column("text")
        sides, index = [], []
        for s in np.unique(side):
            # rows that repeat an id and a text bring their set more than once
            at = np.array(list({sigs[k]: k for k in np.flatnonzero(side == s).tolist()}.values()))
            found = [(grams, np.diff(bounds)) for _, grams, bounds in _sets(texts.take(pa.array(at)), size)]
            sides.append((np.concatenate([g for g, _ in found]).view(np.int64), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in found]))])))
            index.append(at)
        index = np.concatenate(index)
        if len(sides) == 1 and int(table.column("i")[0].as_py()) != int(table.column("j")[0].as_py()):
            found = np.zeros((0, 2), np.int64)
        else:
            found = _links(sides, percent)
        some = found if every else found[_forest(found, len(index))]
        a, b = ([sigs[k] for k in index[some[:, c]].tolist()] for c in (0, 1))
        n = [None] * len(some)
        if not every:
            rows = np.zeros(len(index), np.int64)
            np.add.at(rows, found[:, 0], copies[index[found[:, 1]]])
            np.add.at(rows, found[:, 1], copies[index[found[:, 0]]])
            at = np.flatnonzero(rows)
            a, b, n = a + [sigs[k] for k in index[at].tolist()], b + [None] * len(at), n + rows[at].tolist()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})

    return run


def _bound_tile(percent: int):
    """Of a task group's pairs of texts whose bitmaps leave a link possible, as many as tie its texts together."""

    def run(table: pa.Table) -> pa.Table:
        side, size, key = (table.column(c).to_numpy() for c in ("side", "n_shingles", "key"))
        bits = table.column("bits").to_pylist()
        width = min(map(len, bits))
        trees, ranks = [], []
        for s in np.unique(side):
            at = np.flatnonzero(side == s)
            at = at[np.argsort(size[at], kind="stable")]
            trees.append(_Tree(_folded([bits[k] for k in at.tolist()], width), size[at]))
            ranks.append(at)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # one block alone in a group of two: the other one is in another family
        if len(trees) == 2 or table.column("i")[0].as_py() == table.column("j")[0].as_py():
            a, b = _candidates(trees[0], trees[-1], len(trees) == 1, percent)
            a, b = ranks[0][a], ranks[-1][b]
            ties = _forest(np.stack([a, b], axis=1), len(key))
            a, b = a[ties], b[ties]
        return pa.table({"a": pa.array(key[a]), "b": pa.array(key[b])})

    return run


def _split(members: DataFrame, percent: int, rows: int) -> DataFrame:
    """Members of families of several blocks, which chance agreements hold together, in the families that their bitmaps leave; texts that can link with none go. `rows`: about how many."""
    large = members.groupBy("fam").agg((F.min("block") < F.max("block")).alias("several")).where("several").select("fam")
    own = members.join(large, "fam", "left_semi")
    dealt = own.select("fam", "block", "key", "n_shingles", "bits").join(_tiles(own, percent), ["fam", "block"])
    dealt = dealt.select("key", "n_shingles", "bits", F.inline("tiles"))
    edges = dealt.groupBy("fam", "i", "j").applyInArrow(_bound_tile(percent), "a bigint, b bigint")
    ties = components(edges, "a", "b", rows).select(F.col("node").alias("key"), F.col("root").alias("fam"))
    whole = members.join(large, "fam", "left_anti").drop("block")
    return whole.unionByName(own.drop("fam", "block").join(ties, "key"))


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """fam, block and the task groups that the block takes part in: pairs of blocks of a family whose sizes allow a link."""
    blocks = members.groupBy("fam", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.fam") == F.col("b.fam")) & (F.col("a.block") <= F.col("b.block")) & (F.col("a.high") * 100 >= F.col("b.low") * percent)).select(
        F.col("a.fam").alias("fam"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    sides = pairs.select("fam", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionAll(
        pairs.where("i < j").select("fam", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    return sides.groupBy("fam", "block").agg(F.collect_list(F.struct("fam", "i", "j", "side")).alias("tiles"))


def links(docs: DataFrame, sketch: DataFrame, size: int = SIZE, percent: int = PERCENT, common: np.ndarray | None = None) -> DataFrame:
    """All pairs a, b of different set signatures that link, each once."""
    return _compared(docs, sketch, size, percent, True, common).select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with a block number: one block for a family that fits it, else classes of set size, the larger ones cut by hash."""
    whole = members.groupBy("fam").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("grams"))
    large = whole.where((F.col("texts") > BLOCK_TEXTS) | (F.col("grams") > BLOCK_GRAMS)).select("fam", F.lit(True).alias("large"))
    band = F.when(F.col("large"), F.floor(F.log("n_shingles") / float(np.log(CLASS)))).otherwise(0).cast("bigint")
    classed = members.join(large, "fam", "left").withColumn("band", band).drop("large")
    parts = classed.groupBy("fam", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_GRAMS)).alias("cuts"))
    block = F.shiftleft("band", 32) + F.pmod(F.xxhash64("sig"), "cuts")
    return classed.join(parts, ["fam", "band"]).withColumn("block", block).drop("band", "cuts")


def _compared(docs: DataFrame, sketch: DataFrame, size: int, percent: int, every: bool, common: np.ndarray | None = None) -> DataFrame:
    # about one part for two n-grams
    grams, texts = sketch.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("sig")).first()
    edges = part_edges(docs, size, percent, max(1, grams // (2 * BUCKET_PARTS)), common)
    families = components(edges, "key", "least", EDGES * texts).select(F.col("node").alias("key"), F.col("root").alias("fam"))
    # one text stands for a set, wherever it comes from: ids may be null or repeat
    one = F.min(F.struct("text_key", F.col("doc_id").isNull().alias("without"), "doc_id"))
    members = sketch.where("sig IS NOT NULL").groupBy("sig", "key", "n_shingles").agg(one.alias("one"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")).join(families, "key")
    members = stored(gathered(members, texts, WIDE_ROWS), "families")
    members = stored(gathered(_blocks(members), texts, WIDE_ROWS), "members")
    members = stored(gathered(_split(members, percent, texts), texts, WIDE_ROWS), "families")
    members = stored(gathered(_blocks(members).drop("bits"), texts), "members")
    placed = members.join(_tiles(members, percent), ["fam", "block"]).select("one", "sig", "copies", "tiles")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
    rows = rows.join(placed, (F.col("hash") == F.col("one.text_key")) & F.col("id").eqNullSafe(F.col("one.doc_id")))
    # texts are dealt, not their n-grams: they are shorter and the shuffle can compress them
    dealt = _with_sets(rows, size).select("sig", "copies", "text", F.inline("tiles"))
    found = dealt.groupBy("fam", "i", "j").applyInArrow(_tile(size, percent, every), "a binary, b binary, n bigint")
    return gathered(found, texts, BLOCK_TEXTS)


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of each row, what the task groups found, and for each set signature its component's root, smallest id and copies."""
    sketch = stored(sketches(docs, size), "sketch")
    found = stored(_compared(docs, sketch, size, percent, False, common_grams(docs, size)), "links")
    ties = found.where("b IS NOT NULL")
    tied = components(ties, "a", "b", ties.count())
    classes = sketch.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return sketch, found, classes.join(tied, F.col("sig") == F.col("node"), "left").select("sig", "rep", "copies", F.coalesce("root", "sig").alias("root"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text; further columns are left alone): doc_id, n_shingles, n_links, component_id."""
    sketch, found, named = _classes(docs.select("doc_id", "text"), size, percent)
    linked = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = named.join(least, "root").join(linked, F.col("sig") == F.col("a"), "left").select(
        F.col("sig").alias("s"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = sketch.select("doc_id", "n_shingles", "sig")
    return rows.join(per_class, F.col("sig") == F.col("s"), "left").select(
        "doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id and text_key (xxhash64 of the text) of one row of each component: the one with the smallest id, null ids last.

    Rows with an empty set stand for themselves, each doc_id and text once. `copies`: rows of this id and text.
    """
    sketch, _, named = _classes(docs.select("doc_id", "text"), size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col("sig").alias("first_sig"), "text_key")
    first = sketch.where("sig IS NOT NULL").groupBy("sig").agg(F.min(order).alias("first"))
    kept = first.join(named.select("sig", "root"), "sig").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    kept = kept.unionAll(sketch.where("sig IS NULL").select("doc_id", "text_key").distinct())
    more = sketch.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = (F.col("text_key") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return kept.join(more, same, "left").select("doc_id", "text_key", F.coalesce("n", F.lit(1)).alias("copies"))
