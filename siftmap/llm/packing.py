"""Best-fit packing of tokenised documents by bin completion, a branch-and-bound search.

Documents become token ids and an end id; those longer than a sequence are cut into full pieces and a rest. Pieces are dealt by
hash to groups of a bounded number, each packed on its own: bins are completed around the largest open piece with the fillings
that no other filling dominates, all of them, least waste first, each made when the search asks for it. Best-fit packing is the first
incumbent, and branches end where the waste they already hold reaches the incumbent's. The only stop is a number of fillings per group
(NODES); `above_bound` says by how many sequences a group ended above tokens / capacity, so 0 proves that fewer are impossible.
Every piece of a group is in exactly one sequence, without gaps; only the last sequence of a group can be far from full, so the loss
does not grow with the input.

Defined cases: a null or empty text is one piece of the end id alone; repeated rows are packed each; a null doc_id is kept as null.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.llm.memory import returning
from siftmap.llm.wordhash import Alphabet, chunks, mix, words

CAPACITY = 4096
END_ID = 1
#: Pieces of one packing group: the memory of a task, and one part-filled sequence in so many pieces.
GROUP_PIECES = 20_000
#: Fillings the search of a group looks at, beyond one for each piece; then the incumbent stands.
NODES = 20_000
#: Bins, the last ones, whose enumeration stays in memory.
KEPT = 64
#: Words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 250_000
#: Plain words encoded as one text.
JOINED = 256
#: Texts encoded in one call: what the tokenizer holds of each is far larger than its ids.
TURN = 32

#: Text between ASCII spaces and line feeds; the vocabulary's ids of a text are those of its parts in order.
PARTS = Alphabet(separators=b"\x20\x0a")
#: As PARTS, with case kept: a special token's spelling has a case.
CASED = Alphabet(separators=b"\x20\x0a", fold_case=False)

# Parts are cut further between letters or digits and ASCII marks, where the vocabulary's pattern always cuts. An apostrophe
# may belong to a following letter, and < | > to a special token.
_PLAIN, _SIGN = 1, 2
_CLASS = np.zeros(256, np.int8)
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _PLAIN
_CLASS[list(b"!\"#$%&()*+,-./:;=?@[]^_`{}~\\")] = _SIGN


def breaks(data: np.ndarray) -> np.ndarray:
    """Bytes before which a part ends though no space does."""
    kind = _CLASS[data]
    # two-byte letters of Latin-1 (U+00C0 to U+00FF but the two signs among them)
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[latin]
    kind[latin[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]] = _PLAIN
    out = np.zeros(len(data), bool)
    out[1:] = ((kind[:-1] == _PLAIN) & (kind[1:] == _SIGN)) | ((kind[:-1] == _SIGN) & ((kind[1:] == _PLAIN) | _starts_letter(data)[1:]))
    return out


def _starts_letter(data: np.ndarray) -> np.ndarray:
    """First bytes of two-byte letters of Latin-1."""
    out = np.zeros(len(data), bool)
    first = np.flatnonzero(data[:-1] == 0xC3)
    second = data[first + 1]
    out[first[(second != 0x97) & (second != 0xB7)]] = True
    return out


class Encoder:
    """Token ids of texts, each distinct part encoded once."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the words, ascending
        self.slot = np.zeros(0, np.int64)  # and their places in `first` and `count`
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _tokens(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for i in range(0, len(texts), TURN):
            for e in self.tokenizer.encode_batch_fast(texts[i:i + TURN], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each text.

        Words of letters only end with exactly one id that ends a word, so many are encoded as one text and told apart again.
        """
        plain = np.array([t.lower().isalpha() for t in texts], bool)
        count = np.zeros(len(texts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(plain)
        groups = [at[i:i + JOINED] for i in range(0, len(at), JOINED)]
        for g, ids in zip(groups, self._tokens([" ".join([texts[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(g) or (len(ids) and ends[-1] != len(ids)):
                plain[g] = False
                continue
            count[g] = np.diff(ends, prepend=0)
            found.append((g, ids))
        rest = np.flatnonzero(~plain)
        for i, ids in zip(rest, self._tokens([texts[i] for i in rest])):
            count[i] = len(ids)
            found.append((np.array([i]), ids))
        start = np.cumsum(count) - count
        flat = np.zeros(count.sum(), np.uint32)
        for g, ids in found:
            n = count[g]
            flat[np.repeat(start[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = ids
        return flat, count

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids, count = self._ids(texts)
        k, n = len(self.known), len(texts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.first):
            self.first, self.count = (np.concatenate([v, np.zeros_like(v)]) for v in (self.first, self.count))
        self.flat[self.used:self.used + len(ids)] = ids
        self.first[k:k + n], self.count[k:k + n] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, np.arange(k, k + n))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, flat ids and bounds for each chunk of texts."""
        for chunk in chunks(column):
            special = b"<|" in chunk.data.tobytes()
            w = words(chunk, CASED if special else PARTS, breaks(chunk.data))
            if special:
                w = w._replace(hash=mix(w.hash))
            if len(self.known) > REMEMBERED:
                self.forget()
            if not len(w.hash):
                yield chunk.first, np.zeros(0, np.uint32), np.zeros(len(chunk.offsets), np.int64)
                continue
            distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, distinct)
            new = place == len(self.known)
            new[~new] = self.known[place[~new]] != distinct[~new]
            if new.any():
                raw, own = chunk.data.tobytes(), at[new]
                self._learn(distinct[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[own].tolist(), w.end[own].tolist())])
                place = np.searchsorted(self.known, distinct)
            slot = self.slot[place][back]
            n = self.count[slot]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.first[slot] - total[:-1], n) + np.arange(total[-1])]
            yield chunk.first, ids, total[w.bounds]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for first, ids, bounds in encoder.encode(batch.column(1)):
                for k in range(len(bounds) - 1):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        rows.append(first + k)
                        for col, v in zip(cols, (p, start, len(part), zlib.crc32(part.tobytes()))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Open:
    """Lengths of the open pieces, ascending, how many there are of each, and the same as bits."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = sorted(counts)
        self.left = dict(counts)
        self.bits = sum(1 << v for v in counts)

    def take(self, pieces: Iterable[tuple[int, int]]) -> None:
        for v, n in pieces:
            self.left[v] -= n
            if not self.left[v]:
                self.bits ^= 1 << v

    def put(self, pieces: Iterable[tuple[int, int]]) -> None:
        for v, n in pieces:
            if not self.left[v]:
                self.bits |= 1 << v
            self.left[v] += n


def _parts(n: int) -> Iterator[int]:
    """1, 2, 4, ... and a rest, of which every number up to n is a sum."""
    k = 1
    while n > 0:
        yield min(k, n)
        n -= k
        k *= 2


def _sums(given: _Open, room: int) -> list[int]:
    """Bits of the sums that the first 0, 1, 2, ... lengths can make; ends where all sums up to `room` can be made, as more change nothing."""
    whole = (1 << room + 1) - 1
    out = [1]
    for v in given.lengths:
        made = out[-1]
        if v > room or made == whole:
            break
        for n in _parts(min(given.left[v], room // v)):
            made |= made << n * v
        out.append(made & whole)
    return out


def fillings(given: _Open, room: int, waste: int) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """All undominated fillings of `room` that waste at most `waste`, least waste first: (length, number) pairs, longest first.

    They are made one by one when asked for. None stands for a dominated one, so that the caller can count the work.
    """
    sums = _sums(given, room)

    def exact(below: int, total: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Multisets of the first `below` lengths with exactly this sum; every step leads to one."""
        if not total:
            yield ()
            return
        for i in range(min(below, bisect_right(given.lengths, total)) - 1, -1, -1):
            if not sums[min(i + 1, len(sums) - 1)] >> total & 1:
                return
            v = given.lengths[i]
            for n in range(min(given.left[v], total // v), 0, -1):
                if sums[min(i, len(sums) - 1)] >> total - n * v & 1:
                    for rest in exact(i, total - n * v):
                        yield ((v, n), *rest)

    for total in range(room, max(-1, room - waste - 1), -1):
        if sums[-1] >> total & 1:
            for found in exact(len(given.lengths), total):
                yield None if _dominated(given, found, room - total, room) else found


def _dominated(given: _Open, filling: tuple[tuple[int, int], ...], waste: int, room: int) -> bool:
    """Whether an open piece left out can stand for some of the filling's: for less than its length, or for several that make it up.

    What it stands for then fits wherever it would have gone, so a packing with the other filling needs no more bins.
    """
    one, many = 0, 0  # sums of one piece, of several
    for v, k in filling:
        for n in _parts(k):
            if n == 1:
                many |= (one | many) << v
                one |= 1 << v
            else:
                many |= (1 | one | many) << n * v
    out = given.bits & (1 << room + 1) - 1
    for v, k in filling:
        if given.left[v] == k:
            out &= ~(1 << v)
    if out & many:
        return True
    near = 1 | one | many  # sums raised by 0 to `wide`
    wide = 0
    while wide + 1 < waste:
        step = min(wide + 1, waste - 1 - wide)
        near |= near << step
        wide += step
    return bool(waste and near << 1 & out)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best fit decreasing over a multiset of lengths: each piece into the fullest bin that takes it."""
    open_bins: dict[int, list[list[int]]] = {}
    full = []
    rooms = np.zeros(capacity + 1, bool)
    for v in sorted(counts, reverse=True):
        for _ in range(counts[v]):
            at = v + int(np.argmax(rooms[v:])) if rooms[v:].any() else -1
            if at >= 0:
                b = open_bins[at].pop()
                rooms[at] = bool(open_bins[at])
            else:
                b, at = [], capacity
            b.append(v)
            left = at - v
            if left:
                open_bins.setdefault(left, []).append(b)
                rooms[left] = True
            else:
                full.append(b)
    return [tuple(b) for b in [*full, *(b for some in open_bins.values() for b in some)]]


def complete(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[int, ...]]:
    """Bins (multisets of lengths) for all pieces: the fewest, unless `nodes` fillings beyond one per piece end the search; never more than best fit."""
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    incumbent = _best_fit(counts, capacity)
    total = int(lengths.sum())
    least = -(-total // capacity)
    budget = [nodes + len(lengths)]
    while len(incumbent) > least:
        # the waste that one bin fewer allows
        found = _search(_Open(counts), capacity, (len(incumbent) - 1) * capacity - total, budget)
        if found is None:
            break
        incumbent = found
    return incumbent


class _Bin:
    """A completed bin, and the fillings of it still to try."""

    def __init__(self, big: int, before: int):
        self.big, self.before = big, before
        self.options: Iterator | None = None
        self.tried = 0
        self.filling: tuple[tuple[int, int], ...] = ()


def _search(given: _Open, capacity: int, spare: int, budget: list[int]) -> list[tuple[int, ...]] | None:
    """Bins that waste no more than `spare`, completed around the largest open piece; none, if there are none or the budget ends."""
    bins: list[_Bin] = []
    waste, back = 0, False
    while back or given.bits:
        if back:
            if not bins:
                return None
            b = bins[-1]
            given.put(b.filling)
            waste = b.before
        else:
            b = _Bin(given.bits.bit_length() - 1, waste)
            given.take([(b.big, 1)])
            bins.append(b)
            if len(bins) > KEPT:
                bins[-KEPT - 1].options = None  # made again if the search comes back
        if b.options is None:
            b.options = islice(fillings(given, capacity - b.big, spare - waste), b.tried, None)
        back = True
        for found in b.options:
            b.tried += 1
            budget[0] -= 1
            if budget[0] < 0:
                return None
            if found is not None:
                b.filling = found
                given.take(found)
                waste += capacity - b.big - sum(v * n for v, n in found)
                back = False
                break
        if back:
            given.put([(b.big, 1)])
            bins.pop()
    return [(b.big, *(v for v, n in b.filling for _ in range(n))) for b in bins]


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("grp")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = table.column("length").to_numpy()
        bins = complete(length, capacity)
        by_length: dict[int, list[int]] = {}
        for i in range(len(length) - 1, -1, -1):
            by_length.setdefault(int(length[i]), []).append(i)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for b, content in enumerate(bins):
            at = 0
            for v in content:
                i = by_length[v].pop()
                sequence[i], offset[i] = (key << 32) + b, at
                at += v
        above = np.full(len(length), len(bins) - -(-int(length.sum()) // capacity), np.int64)
        out = table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return out.append_column("above_bound", pa.array(above))

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they go to, and how far their group is above its bound."""
    cut = stored(pieces(docs, vocabulary, capacity, end_id), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    # row numbers of a stored table: the same in a task's retry, and repeated rows part as well as any others
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(
        _pack(capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, above_bound bigint")
