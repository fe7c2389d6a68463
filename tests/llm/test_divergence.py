import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from siftmap.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def by_hand(rows, least=10, most=10):
    """All figures from strings, nothing hashed."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        seen[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in seen}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in seen if g == lang]

        def parts(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        q = parts(sum((seen[lang, s] for s in sources), collections.Counter()))
        p = {s: parts(seen[lang, s]) for s in sources}

        def far(a, b, t):
            return (a[t] - b[t]) ** 2 // (a[t] + b[t])

        for s in sources:
            pairs = sorted((-sum(far(p[s], p[o], t) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-far(p[s], q, t), t.encode(), t) for t in kept if seen[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:most], 1)]
    return sorted(out)


def made(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "straße", "漢字", "ab9cd", "x", "zoo", "Zebra"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = [(k, " ".join(rng.choice(vocabulary[:rng.choice([9, 40, 129])]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice("abcd")) for k in range(n)]
    rows += [(None, None, "fr", None), (5, "", "fr", "a"), (5, "", "fr", "a"), (n, "  ...  ", "en", "empty"), (n + 1, "the " * 50_000, "en", "long")]
    return rows + rows[:7]


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_equal_to_counting_strings(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "GROUP_ROWS", 100)
    monkeypatch.setattr(divergence, "STEP", 64)
    rows = made(300)
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), bits=bits)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in out.collect()) == by_hand(rows)


def test_shared_digests_are_split(spark):
    docs = spark.createDataFrame(made(200), SCHEMA).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, kept, names = divergence.counted(docs, bits=3)
    levels = {r.level for r in names.collect()}
    assert levels >= {1} and names.groupBy("level", "digest").count().where("count > 1").isEmpty()
    assert kept.join(names, ["level", "digest"], "left_anti").isEmpty() and counts.join(kept, ["lang", "level", "digest"], "left_anti").isEmpty()


def test_no_kept_terms_no_rows_and_clashing_names(spark):
    few = [(1, "a b", "en", "x"), (2, "b c", "en", "y"), (3, "d", "de", "x")]
    extra = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in few], SCHEMA + ", digest int, level int, n int, place int")
    assert sorted(map(tuple, divergence.audit(extra).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_counts_beyond_64_bits(spark):
    n = 4 * 10**12
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(9 * 10**12).alias("t"), F.lit(10**7).alias("v"))
    assert row.select(divergence._part(F.col("n"), F.col("t"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 2) // (9 * 10**12 + 2 * 10**7)
