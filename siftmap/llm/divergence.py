"""Source divergence audit: how far the term frequencies of each source lie from those of its language's other sources.

Terms travel as 64-bit digests; their strings come in late:

1. Each task counts (lang, source, digest); what is shuffled has a fixed width per term.
2. For digests that enough documents of a language hold, a second pass brings the smallest and the largest string of each. Where the two
   differ, several terms share the digest: it is split by counting its terms under the next digest, until no digest holds two strings.
3. Frequencies become whole numbers p (parts of a thousand million, smoothed by 2), so every figure is exact. Distances between all sources
   of a language are summed over its kept terms in groups of bounded size, dense within a group; a task returns one sum per pair of sources.
4. The terms that set a source apart are picked by digest, with ties; only then do their strings join, and break the ties.

Cost: kept terms of a language times the pairs of its sources, which are the rows returned. A source's row number within its language
comes from one window over the distinct sources of that language.

Defined cases: null text, lang or source read as ''. Every row is a document of its own, also one that repeats an id or a whole row. Texts without
a term make a group all the same. A language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows. Further
columns of `docs`, whatever their names, are left alone. A text longer than half a megabyte is worked on alone, in some tens of bytes a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.llm.wordhash import Alphabet, chunks, mix, words

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Terms listed per source.
TERMS = 10
#: Frequencies are parts of this.
UNIT = 1_000_000_000
#: Counted (source, term) rows that one distance group takes, about, and numbers of one dense step in it.
GROUP_ROWS = 1 << 19
STEP = 1 << 18

#: Runs of ASCII letters and of anything outside ASCII.
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _alphabet(level: int) -> Alphabet:
    """Digests of one level are independent of those of the next."""
    out = Alphabet(members=_LETTERS)
    if level:
        out.value = mix(out.value + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64)))
    return out


def _digests(chunk, level: int, bits: int):
    """The words of a chunk, and their digests of the level before (none at level 0); `bits` narrows level 0."""
    w = words(chunk, _alphabet(level))
    narrow = np.uint64((1 << bits) - 1)
    if not level:
        return w, w.hash & narrow, np.zeros(len(w.hash), np.uint64)
    before = words(chunk, _alphabet(level - 1)).hash
    return w, w.hash, before & narrow if level == 1 else before


def _counts(docs: DataFrame, level: int, bits: int) -> DataFrame:
    """lang, source, parent (digest of the level before), digest, n, docs; summed up within each batch."""

    def run(batches):
        for batch in batches:
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            wide = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
            parts = []
            for chunk in chunks(batch.column(2)):
                w, digest, parent = _digests(chunk, level, bits)
                order = np.argsort(digest, kind="stable")
                digest, row, parent = digest[order], w.row[order], parent[order]
                new = np.ones(len(digest), bool)
                new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1]) | (parent[1:] != parent[:-1])
                at = np.flatnonzero(new)
                parts.append((group[chunk.first + row[at]], parent[at], digest[at], np.diff(np.r_[at, len(digest)])))
            if not parts:
                continue
            g, parent, digest, n = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((parent, digest, g))
            g, parent, digest, n = g[order], parent[order], digest[order], n[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (digest[1:] != digest[:-1]) | (parent[1:] != parent[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            yield pa.RecordBatch.from_pydict({
                "lang": lang.dictionary.take(pa.array(g[at] // wide)), "source": source.dictionary.take(pa.array(g[at] % wide)),
                "parent": pa.array(parent[at].view(np.int64)), "digest": pa.array(digest[at].view(np.int64)),
                "n": pa.array(np.add.reduceat(n, at)), "docs": pa.array(np.diff(np.r_[at, len(g)]))})

    return docs.mapInArrow(run, "lang string, source string, parent bigint, digest bigint, n bigint, docs bigint")


def _spellings(docs: DataFrame, level: int, bits: int) -> DataFrame:
    """parent, digest, term: each spelling of a batch at least once."""

    def run(batches):
        fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        for batch in batches:
            seen = set()
            for chunk in chunks(batch.column(0)):
                w, digest, parent = _digests(chunk, level, bits)
                data = chunk.data.tobytes().translate(fold)
                # words of equal digest, further digest and length are spelt once; others under that digest too
                other, size = words(chunk, _alphabet(level + 1)).hash, w.end - w.start
                order = np.lexsort((size, other, digest))
                new = np.ones(len(order), bool)
                for v in (digest[order], other[order], size[order]):
                    new[1:] &= v[1:] == v[:-1]
                new[1:] = ~new[1:]
                at = order[new]
                for d, p, s, e in zip(digest[at].tolist(), parent[at].tolist(), w.start[at].tolist(), w.end[at].tolist()):
                    seen.add((p, d, data[s:e]))
            if seen:
                p, d, t = zip(*sorted(seen))
                yield pa.RecordBatch.from_pydict({
                    "parent": pa.array(np.array(p, np.uint64).view(np.int64)), "digest": pa.array(np.array(d, np.uint64).view(np.int64)),
                    "term": pa.array(t, pa.binary()).cast(pa.string())})

    return docs.select("text").mapInArrow(run, "parent bigint, digest bigint, term string")


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang, source, level, digest, n), kept terms (lang, level, digest, n_lang) and names (level, digest, term) of the kept terms.

    A digest at its level stands for one term of `names`; counts hold kept terms only.
    """
    counts, kept, names = [], [], []
    level, shared = 0, None
    while True:
        rows = _counts(docs, level, bits)
        if shared is not None:
            rows = rows.join(shared, "parent", "left_semi")
        here = stored(rows.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        often = stored(here.groupBy("lang", "digest").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
        spelt = _spellings(docs, level, bits)
        if shared is not None:
            spelt = spelt.join(shared, "parent", "left_semi")
        ends = stored(spelt.join(often.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "names")
        split = ends.where("term <> last").select("digest")
        several = not split.isEmpty()
        if several:
            often = often.join(split, "digest", "left_anti")
        mark = F.lit(level).alias("level")
        counts.append(here.join(often.select("lang", "digest"), ["lang", "digest"], "left_semi").select("lang", "source", mark, "digest", "n"))
        kept.append(often.select("lang", mark, "digest", "n_lang"))
        names.append(ends.where("term = last").select(mark, "digest", "term"))
        if not several:
            break
        shared, level = split.select(F.col("digest").alias("parent")), level + 1

    def one(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    return one(counts), one(kept), one(names)


def _part(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exact for any count."""
    def wide(c):
        return c.cast("decimal(20,0)")

    whole = F.call_function("div", wide(F.lit(UNIT)) * wide(n + 2), wide(total) + wide(terms) * wide(F.lit(2)))
    return F.lit(1).cast("bigint") + whole


def _distances(key: tuple, rows: pa.Table, heads: pa.Table) -> pa.Table:
    """Sums of floor((p - q)^2 / (p + q)) over this group's terms, for all pairs i < j of sources."""
    place = heads.column("place").to_numpy()
    plain = np.zeros(len(place), np.int64)
    plain[place] = heads.column("p_none").to_numpy()
    width = len(plain)
    level, digest = rows.column("level").to_numpy(), rows.column("digest").to_numpy()
    order = np.lexsort((digest, level))
    level, digest = level[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (level[1:] != level[:-1])
    term = np.cumsum(new) - 1
    source, p = rows.column("place").to_numpy()[order], rows.column("p").to_numpy()[order]
    out = np.zeros((width, width), np.int64)
    step = max(1, STEP // width)
    for first in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        low, high = np.searchsorted(term, [first, first + step])
        table = np.repeat(plain[:, None], min(step, int(term[-1]) + 1 - first), axis=1)
        table[source[low:high], term[low:high] - first] = p[low:high]
        for i in range(width - 1):
            apart = table[i + 1:] - table[i]
            out[i, i + 1:] += (apart * apart // (table[i + 1:] + table[i])).sum(axis=1)
    i, j = np.triu_indices(width, 1)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "value": pa.array(out[i, j])})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, bits: int = 64) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for rows (text, lang, source).

    `bits` narrows the first digest, to try the splitting.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, kept, names = counted(docs, least_docs, bits)
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n_lang").alias("total_lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    heads = stored(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", place.cast("bigint").alias("place"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
            F.coalesce("total_lang", F.lit(0)).alias("total_lang"), F.coalesce("rows", F.lit(0)).alias("rows")), "heads")
    size = heads.groupBy("lang").agg(F.ceil(F.sum("rows") / GROUP_ROWS).alias("groups"))
    heads = heads.join(size, "lang")
    cells = stored(
        counts.join(kept, ["lang", "level", "digest"]).join(heads, ["lang", "source"]).select(
            "lang", "source", "level", "digest", "place", "groups",
            _part(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"), _part(F.col("n_lang"), F.col("total_lang"), F.col("n_terms")).alias("q")), "cells")

    dealt = cells.select("lang", F.expr("pmod(xxhash64(level, digest), groups)").alias("bucket"), "level", "digest", "place", "p")
    spread = heads.where("n_terms > 0").select(
        "lang", F.explode(F.expr("sequence(0L, groups - 1)")).alias("bucket"), "place", _part(F.lit(0), F.col("total"), F.col("n_terms")).alias("p_none"))
    summed = dealt.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(_distances, "lang string, i bigint, j bigint, value bigint")
    summed = summed.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = stored(summed, "distances")
    both = both.unionAll(both.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    a = heads.select("lang", "source", F.col("place").alias("i"))
    b = heads.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    pairs = a.join(b, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    above = cells.where("p > q").select("lang", "source", "level", "digest", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    top = above.withColumn("at", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("at") <= terms).drop("at")
    named = top.join(names, ["level", "digest"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= terms)
    return pairs.unionAll(named)
