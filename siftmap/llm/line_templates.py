"""Line deduplication by a log-template tree.

Lines are parsed into a tree of fixed depth: by their number of tokens, then by their leading tokens, where a token with a
digit is a variable field. Within a leaf, a token is constant at its place if at least `min_docs` lines of the leaf have it
there; elsewhere the template has a variable field, so lines that differ in such fields share a template. A template recurs
if its lines are in at least `min_docs` documents and at least `constant` of its tokens are constant. Of a recurring template
the lines of the document with the smallest id stay, so that no text is lost altogether; those of all others are dropped.

With `exact_docs`, a line of at least `exact_tokens` tokens also recurs if that many documents hold it verbatim (the same tokens, digits
included), whatever its template; again the document with the smallest id keeps it. With `exact_texts` copies of a whole text count once.

Support is counted, not searched: every step is a grouped count whose parts combine before the shuffle, and no leaf is ever
held by one task. What is shuffled per line are numbers; tokens are formed only for lines in leaves that can recur.

Defined cases: a null text has no lines and stays null; lines of fewer than `min_tokens` tokens and blank lines always stay; a
line repeated within a document counts once; rows with a null doc_id are not compared and keep all their lines; rows that repeat
a doc_id are one document. Lines end at a line feed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import gathered, stored
from siftmap.llm.memory import returning
from siftmap.llm.wordhash import Alphabet, Chunk, chunks, mix, words

MIN_DOCS = 5
#: Leading tokens that lead to a leaf.
DEPTH = 3
CONSTANT = 0.7
MIN_TOKENS = 3
#: Documents with the same line, and tokens from which on a line is no chance sentence: for op3_line_templates and the pipeline.
EXACT_DOCS, EXACT_TOKENS = 2, 8
#: Hash classes of leaves by which lines are picked for a closer look; a class may hold others, which a join sorts out.
CLASSES = 1 << 21
#: Tokens of a line, about; they decide on the partitions of a stored table only.
LINE_TOKENS = 8

#: Tokens lie between ASCII white space; a line feed also ends a line.
TOKENS = Alphabet(separators=b"\x20\x09\x0a\x0b\x0c\x0d", fold_case=False)
_VARIABLE = np.uint64(0x6A09E667F3BCC909)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class _Lines:
    """The lines of a chunk of texts, with hashes of their tokens; tokens with a digit are one variable token."""

    def __init__(self, chunk: Chunk, depth: int):
        data, offsets = chunk.data, chunk.offsets
        feeds = np.flatnonzero(data == 10)
        cuts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
        self.text = np.searchsorted(offsets, cuts, "right") - 1
        full = (cuts < len(data)) & (self.text < len(offsets) - 1)
        self.cuts, self.text = cuts[full], self.text[full]
        first = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.number = np.arange(len(self.cuts)) - first[self.text]
        w = words(Chunk(0, data, np.append(self.cuts, len(data))), TOKENS)
        self.token = w.hash.copy()
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        self.token[digits[w.end] > digits[w.start]] = _VARIABLE
        self.row, self.bounds = w.row, w.bounds
        self.count = np.diff(w.bounds)
        place = (np.arange(len(self.token)) - self.bounds[self.row]).astype(np.uint64)
        placed = mix(self.token + mix(place + np.uint64(1)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
        raw = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix(place + np.uint64(1))), dtype=np.uint64)])
        self.exact = mix(raw[self.bounds[1:]] - raw[self.bounds[:-1]] + self.count.astype(np.uint64))
        self.line = mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.count.astype(np.uint64))
        lead = np.minimum(self.bounds[:-1] + depth, self.bounds[1:])
        self.leaf = mix(total[lead] - total[self.bounds[:-1]] + mix(self.count.astype(np.uint64) + np.uint64(0x3C6EF372)))


def lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, exact_tokens: int | None = None) -> DataFrame:
    """doc_id, text_key (a hash of the text), number (of the line in it, from 0), leaf, line, exact of lines of at least `min_tokens` tokens.

    `exact` is a hash of all tokens, null for lines of fewer than `exact_tokens` or without such a number.
    """

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                own = _Lines(chunk, depth)
                at = np.flatnonzero(own.count >= min_tokens)
                short = np.ones(len(at), bool) if exact_tokens is None else own.count[at] < exact_tokens
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(chunk.first + own.text[at])), batch.column(2).take(pa.array(chunk.first + own.text[at])),
                     pa.array(own.number[at], pa.int32()), pa.array(own.leaf[at].view(np.int64)), pa.array(own.line[at].view(np.int64)),
                     pa.array(own.exact[at].view(np.int64), mask=short)],
                    ["doc_id", "text_key", "number", "leaf", "line", "exact"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(returning(run), "doc_id bigint, text_key bigint, number int, leaf bigint, line bigint, exact bigint")


def _leaf_classes(leaves: DataFrame) -> np.ndarray:
    """Which of `CLASSES` hash classes hold a leaf of `leaves`: a bitmap of fixed size, put together by Spark."""
    c = F.pmod("leaf", F.lit(CLASSES)) + 1
    rows = leaves.select(F.bitmap_bucket_number(c).alias("bucket"), F.bitmap_bit_position(c).alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros(CLASSES // 8, np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        at = (bucket - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bits, np.uint8)[:len(out) - at]
    return out


def _tokens(docs: DataFrame, classes: np.ndarray, depth: int, min_tokens: int) -> DataFrame:
    """leaf, line, tokens, place, token of the lines in these classes of leaves, once per line and Arrow batch at least."""

    def run(batches):
        chosen = np.unpackbits(classes, bitorder="little").view(bool)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                own = _Lines(chunk, depth)
                at = np.flatnonzero((own.count >= min_tokens) & chosen[own.leaf.view(np.int64) % CLASSES])
                r = at[np.unique(own.line[at], return_index=True)[1]]
                n = own.count[r]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                token = own.token[place + np.repeat(own.bounds[r], n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.leaf[r].view(np.int64), n)), pa.array(np.repeat(own.line[r].view(np.int64), n)),
                     pa.array(np.repeat(n, n), pa.int32()), pa.array(place, pa.int32()), pa.array(token.view(np.int64))],
                    ["leaf", "line", "tokens", "place", "token"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(returning(run), "leaf bigint, line bigint, tokens int, place int, token bigint")


def recurring(
    docs: DataFrame, found: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, constant: float = CONSTANT, min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """leaf, line, template, keeper (smallest document) of every line of a recurring template; `found` is lines() as stored."""
    distinct = found.groupBy("leaf", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"))
    leaves = found.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("a"), F.max("line").alias("b")).where(F.col("rows") >= min_docs)
    n = found.count()
    known = stored(gathered(distinct.join(leaves.select("leaf", (F.col("a") != F.col("b")).alias("mixed")), "leaf"), n), "lines")
    alone = known.where("NOT mixed").select("leaf", "line", F.col("line").alias("template"), F.lit(True).alias("fixed"))
    mixed = known.where("mixed").select("leaf", "line", "docs")
    spelt = _tokens(docs, _leaf_classes(mixed.select("leaf")), depth, min_tokens).dropDuplicates(["leaf", "line", "place"])
    tokens = stored(gathered(spelt.join(mixed, ["leaf", "line"]), LINE_TOKENS * n), "tokens")
    backed = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("lines")).where(F.col("lines") >= min_docs).drop("lines")
    # a constant token's place and value enter the template's hash, so the order of the sum does not matter
    parts = tokens.join(backed, ["leaf", "place", "token"]).groupBy("leaf", "line", "tokens").agg(
        F.count(F.lit(1)).alias("constants"), F.sum(F.xxhash64("place", "token").cast("decimal(38,0)")).alias("total"))
    several = parts.select("leaf", "line", F.xxhash64("leaf", "total").alias("template"), (F.col("constants") >= constant * F.col("tokens")).alias("fixed"))
    named = alone.unionAll(several).where("fixed").select("leaf", "line", "template")
    holders = found.select("leaf", "line", "doc_id").join(named, ["leaf", "line"]).groupBy("template", "doc_id").agg(F.lit(1).alias("one"))
    often = holders.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    return named.join(often.select("template", "keeper"), "template").select("leaf", "line", "template", "keeper")


def repeated(found: DataFrame, exact_docs: int, exact_texts: bool = False) -> DataFrame:
    """exact, keeper (smallest document) of every line that at least `exact_docs` documents (or different texts) hold verbatim."""
    by = "text_key" if exact_texts else "doc_id"
    holders = found.where("exact IS NOT NULL").groupBy("exact", by).agg(F.min("doc_id").alias("first"))
    return holders.groupBy("exact").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("keeper")).where(F.col("n") >= exact_docs).select("exact", "keeper")


def dropped(
    docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, constant: float = CONSTANT, min_tokens: int = MIN_TOKENS,
    exact_docs: int | None = None, exact_tokens: int = EXACT_TOKENS, exact_texts: bool = False,
) -> DataFrame:
    """doc_id, text_key, numbers: the lines to drop, for each text with some."""
    found = stored(lines(docs, depth, min_tokens, None if exact_docs is None else exact_tokens), "found")
    again = recurring(docs, found, min_docs, depth, constant, min_tokens)
    gone = found.select("doc_id", "text_key", "number", "leaf", "line").join(again.select("leaf", "line", "keeper"), ["leaf", "line"]).where("doc_id != keeper").select("doc_id", "text_key", "number")
    if exact_docs is not None:
        same = found.select("doc_id", "text_key", "number", "exact").join(repeated(found, exact_docs, exact_texts), "exact")
        gone = gone.unionAll(same.where("doc_id != keeper").select("doc_id", "text_key", "number"))
    return stored(gathered(gone.groupBy("doc_id", "text_key").agg(F.collect_set("number").alias("numbers")), found.count()), "dropped")


def dedup(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` (any columns beside doc_id and text) with recurring lines taken out of `text`; n_lines and n_dropped are added."""
    gone = dropped(docs.select("doc_id", "text"), **settings).select(
        F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key"), F.col("numbers").alias("__gone"))
    cut = F.split("text", "\n", -1)
    kept = F.filter(cut, lambda _, i: ~F.array_contains("__gone", i))
    joined = docs.join(gone, (F.col("doc_id") == F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_key")), "left")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(cut))
    lost = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return joined.withColumns({"n_lines": n.cast("bigint"), "n_dropped": lost.cast("bigint"), "text": text}).select(*docs.columns, "n_lines", "n_dropped")
