"""Spelling variant grouping by neighbourhoods that Bloom filters guide.

1. The words of all texts are counted by Spark; a stated share of the places loses a letter first, by a hash of document and word.
2. Blocked Bloom filters, one per word length (a block is one 64-bit number in which a word sets four bits), are put together by Spark and
   broadcast. Their size follows the vocabulary up to MOST_BLOCKS numbers; a larger vocabulary is cut by hash into slices, each probed in a
   round of its own by all words, so the broadcast stays bounded and nothing is left out.
3. Each word probes its edits: all deletions, and those replacements that put a larger code point in. The other edits are these seen from the
   other word, so every near pair is probed exactly once. Edits are hashed from running sums, never spelt unless a filter answers yes.
4. Only such answers are shuffled, to an exact join with the vocabulary that removes the false ones. Near words are counted from both sides,
   a word's form is its most frequent near word, and roots are found by doubling steps along the forms.

Defined cases: a null text has no words; a null id is read as empty; repeated rows count again, with the same letters lost; of two forms with
equal counts the first in code-point order is taken; an empty table gives no rows. Words of 64 letters and more share one filter. A text's
words are one array while it is worked on, about 60 bytes a word; a very long word costs its length times the alphabet in hashes. Further
columns of `docs`, whatever their names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.llm.wordhash import mix

LEAST_LENGTH = 6
LEAST_N = 5
#: A form is at least so many times as frequent.
TIMES = 5
#: One in so many (document, word) pairs loses a letter.
SLIPS = 199
#: Bits of a filter for each word, and 64-bit numbers that one broadcast holds at most (32 MB).
BITS = 16
MOST_BLOCKS = 1 << 22
#: Words of this length and longer share a filter.
LONGEST = 64
#: Words of one probing task, about, and letters or edits of one step in it.
TASK_WORDS = 8192
STEP = 1 << 18

_RUN = r"[A-Za-zÀ-ÿ]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word and n for the words of rows (doc_id, text)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({_RUN})"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % SLIPS == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_n))


def _powers(size: int) -> np.ndarray:
    out = np.full(size + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]):
    """Positions of the words of each length, and their letters as rows of one matrix, in steps of bounded size."""
    spelt = [w.encode("latin-1") for w in words]
    size = np.array([len(s) for s in spelt], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = max(1, STEP // max(n, 1))
        for k in range(0, len(at), step):
            some = at[k:k + step]
            yield some, np.frombuffer(b"".join(spelt[i] for i in some), np.uint8).reshape(len(some), n)


class _Layout:
    """Where a hashed word of a length lies in the filters, and in which slice."""

    def __init__(self, sizes: dict[int, int], slices: int):
        self.slices = slices
        self.blocks = np.zeros(LONGEST + 1, np.uint64)
        for length, n in sizes.items():
            self.blocks[length] = max(1, -(-n * BITS // (64 * slices)))
        self.first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.blocks, dtype=np.uint64)])
        self.total = int(self.first[-1])

    def slice_of(self, key: np.ndarray) -> np.ndarray:
        return (mix(key ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(self.slices)).astype(np.int64)

    def place(self, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits."""
        shard = min(length, LONGEST)
        block = self.first[shard] + (((key >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32))
        bits = np.zeros(len(key), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << ((key >> np.uint64(6 * k)) & np.uint64(63))
        return block.astype(np.int64), bits


def _keys(letters: np.ndarray) -> np.ndarray:
    size = letters.shape[1]
    return mix((_VALUE[letters] * _powers(size)[:size]).sum(axis=1, dtype=np.uint64) + np.uint64(size))


def _filter(words: DataFrame, layout: _Layout, part: int) -> np.ndarray:
    """The filters of one slice, of layout.total numbers."""

    def run(batches):
        for batch in batches:
            for _, letters in _by_length(batch.column(0).to_pylist()):
                key = _keys(letters)
                key = key[layout.slice_of(key) == part]
                block, bits = layout.place(key, letters.shape[1])
                yield pa.RecordBatch.from_pydict({"block": pa.array(block), "bits": pa.array(bits.view(np.int64))})

    rows = words.select("word").mapInArrow(run, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, layout.total), np.uint64)
    out[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _edits(letters: np.ndarray, alphabet: np.ndarray):
    """Steps of (row, place, letter put in or -1 if one is taken out, key, length) over all probed edits."""
    rows, size = letters.shape
    power = _powers(size)
    value = _VALUE[letters]
    head = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(value * power[:size], axis=1, out=head[:, 1:])
    whole = head[:, -1]
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    row = np.arange(rows)
    for i in range(size):
        # of a run of equal letters the last one is taken out
        at = row if i == size - 1 else row[letters[:, i] != letters[:, i + 1]]
        if size > 1:
            key = head[at, i] + (whole[at] - head[at, i + 1]) * back
            yield at, i, -1, mix(key + np.uint64(size - 1)), size - 1
        for c in alphabet.tolist():
            at = row[letters[:, i] < c]
            if len(at):
                key = whole[at] + (_VALUE[c] - value[at, i]) * power[i]
                yield at, i, c, mix(key + np.uint64(size)), size


def probed(words: DataFrame, alphabet: list[int], layout: _Layout, part: int, tasks: int) -> DataFrame:
    """edit, word, n: the edits of each word that the filters of a slice don't rule out."""
    filters = words.sparkSession.sparkContext.broadcast(_filter(words, layout, part))
    codes = np.array(sorted(alphabet), np.uint8)

    def run(batches):
        table = filters.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for some, letters in _by_length(words):
                edits, source = [], []
                for row, i, c, key, length in _edits(letters, codes):
                    if layout.slices > 1:
                        own = layout.slice_of(key) == part
                        row, key = row[own], key[own]
                    if not len(row) or not layout.blocks[min(length, LONGEST)]:
                        continue
                    block, bits = layout.place(key, length)
                    for r in row[(table[block] & bits) == bits].tolist():
                        w = words[some[r]]
                        edits.append(w[:i] + ("" if c < 0 else chr(c)) + w[i + 1:])
                        source.append(some[r])
                yield pa.RecordBatch.from_pydict({"edit": pa.array(edits, pa.string()), "word": pa.array([words[k] for k in source], pa.string()), "n": pa.array(n[source], pa.int64())})

    return words.repartition(tasks, "word").mapInArrow(run, "edit string, word string, n bigint")


def near_pairs(words: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """word, n, other, other_n for all ordered pairs of near words of a table (word, n)."""
    sizes = {r.length: r.n for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = [ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]]
    slices = max(1, -(-sum(sizes.values()) * BITS // (64 * most_blocks)))
    layout = _Layout(sizes, slices)
    tasks = max(1, -(-sum(sizes.values()) // TASK_WORDS))
    target = words.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    pairs = None
    for part in range(slices):
        found = probed(words, letters, layout, part, tasks).join(target, "edit").select("word", "n", F.col("edit").alias("other"), "other_n")
        pairs = found if pairs is None else pairs.unionAll(found)
    pairs = stored(pairs, "near")
    return pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame, most_n: int, times: int = TIMES) -> DataFrame:
    """word and root for a table (word, form) in which each form is at least `times` as frequent as its word and none more than `most_n` times."""
    steps = max(1, math.ceil(math.log(max(most_n, 2), times)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = stored(out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return out


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, times: int = TIMES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of rows (doc_id, text)."""
    words = stored(vocabulary(docs.select("doc_id", "text"), least_length, least_n), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(words, most_blocks).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = -F.col("best.n") >= F.col("n") * times
    near = stored(near.select("word", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "forms")
    most_n = words.agg(F.max("n")).first()[0] or 1
    rooted = roots(near.where("form IS NOT NULL"), most_n, times)
    return words.join(near, "word", "left").join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
