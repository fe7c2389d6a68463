import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmap.llm import context_mixing as cm
from siftmap.llm.wordhash import chunks

SCHEMA = "doc_id long, text string"
VOCABULARY = ["the", "of", "and", "House", "straße", "漢字", "x.", "réd", "wander", "tele"] + [f"w{k}" for k in range(60)]


def made(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice([" ", "\n"]).join(rng.choice(VOCABULARY[:rng.choice([4, 10, 70])]) for _ in range(rng.randrange(60)))) for k in range(n)]
    return rows + rows[:5] + [(None, "the Of and"), (None, None), (n, ""), (n + 1, " \t\n"), (n + 2, "q" * 500), (n + 3, "the house " * 2000), (n + 4, "new\x00word zz")]


def tokens(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold)) + [None]


def remainder(doc):
    return None if doc is None else zlib.crc32(str(doc).encode()) % 5


@pytest.fixture(scope="module")
def scored(spark):
    rows = made(150)
    return rows, cm.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), coded=20)


def test_base_by_hand(scored):
    rows, out = scored
    seen = collections.Counter(t for d, text in rows if remainder(d) != 1 for t in tokens(text))
    total, below = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    want = [(d, remainder(d) == 1, len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), total, sum(math.log10((seen[w] + 0.5) / below) for w in tokens(t))) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r)[:6] for r in out.collect()), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_scores_are_probabilities_and_equal_for_equal_texts(scored):
    rows, out = scored
    got = out.collect()
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    by = collections.defaultdict(set)
    text = dict(rows)
    for r in got:
        if r.doc_id is not None:
            by[text[r.doc_id]].add(round(r.score, 6))
    assert all(len(v) == 1 for v in by.values())


def test_bits_tell_the_text():
    """Decoding the bits along the codes gives the words back, and the codes fill the tree."""
    hashes = sorted({int(h) for h in cm.words(next(chunks(pa.array(["the of and house w1"]))), cm.SPACED).hash} | {cm.END})
    built = cm.huffman([5 + k for k in range(len(hashes))] + [3])
    codes = cm.Codes(np.array(hashes, np.uint64), np.arange(1, len(hashes) + 1), np.array([c for c, _ in built[:-1]], np.uint64), np.array([n for _, n in built[:-1]]), built[-1], None, None)
    letters = cm.huffman([1 + b % 7 for b in range(256)])
    codes = codes._replace(byte_code=cm._split(letters)[0], byte_size=cm._split(letters)[1])
    assert sum(2.0**-n for _, n in built) == 1 == sum(2.0**-n for _, n in letters)
    byte_of = {(n, c): b for b, (c, n) in enumerate(letters)}
    texts = ["the Of réd and", "", "w1 w2 house", None, "\x00 漢字"]
    chunk = next(chunks(pa.array(texts)))
    t = cm._tokens(chunk, codes)
    b = cm._bits(chunk, t, codes, 16)
    back = {(n, c): h for h, (c, n) in zip(hashes, built[:-1])}
    spelt = {h: w for w, h in zip(["the", "of", "and", "house", "w1"], cm.words(next(chunks(pa.array(["the of and house w1"]))), cm.SPACED).hash.tolist())}
    for row, text in enumerate(texts):
        bits = b.bit[np.repeat(np.arange(len(texts)), b.sizes) == row].tolist()
        out, at = [], 0
        while at < len(bits):
            code, n = 0, 0
            while (n, code) not in back and (code, n) != codes.escape:
                code, n, at = code << 1 | bits[at], n + 1, at + 1
            if (code, n) == codes.escape:
                word = bytearray()
                while True:
                    code, n = 0, 0
                    while (n, code) not in byte_of:
                        code, n, at = code << 1 | bits[at], n + 1, at + 1
                    byte = byte_of[n, code]
                    if byte == cm.BLANK:
                        break
                    word.append(byte)
                out.append(word.decode())
            else:
                out.append(spelt.get(back[n, code]))
        assert out == tokens(text)


def test_coding_equals_a_loop_over_bits(monkeypatch):
    monkeypatch.setattr(cm, "STEP_BITS", 4)
    rng = np.random.default_rng(4)
    texts = 3
    n = [100, 0, 37]
    row = np.repeat(np.arange(texts), n)
    size = [1 << cm.PLAIN_BITS, 1 << 16, 1 << 16]
    tables = [cm._odds(rng.integers(0, 30, s), rng.integers(0, 30, s)) for s in size]
    b = cm._Bits(np.array(n), rng.integers(0, 2, len(row)), rng.integers(0, 2, len(row)).astype(np.uint8), [rng.integers(0, s, len(row)) for s in size])
    weights, refined = rng.normal(0.3, 0.1, (cm.GATES, cm.INPUTS)), np.sort(rng.random((cm.KINDS, cm.CELLS)))
    got = cm._code(b, cm.Model(None, tables, weights, refined))
    cost = np.zeros(texts)
    for t in range(texts):
        own = weights.copy()
        mine = np.flatnonzero(row == t)
        for first in range(0, len(mine), 16):
            change, met = np.zeros_like(own), np.zeros(cm.GATES)
            for i in mine[first:first + 16]:
                v = [int(tables[k][b.slots[k][i]]) for k in range(3)]
                x = np.array([((w >> 3) - 4096) / 512 for w in v])
                g = b.kind[i] * 16 + (v[1] & 7) * 4 + (v[2] & 7)
                dot = float(np.clip(own[g] @ x, -12, 12))
                p = 1 / (1 + math.exp(-dot))
                change[g] += (b.bit[i] - p) * x
                met[g] += 1
                q = 0.5 * p + 0.5 * refined[b.kind[i], round(min(max(dot, -8), 8) * 2 + 16)]
                cost[t] -= math.log2(q if b.bit[i] else 1 - q)
            own += cm.RATE * change / (met + 32)[:, None]
        assert got.weights[t] == pytest.approx(own, rel=1e-3)
    assert got.bits == pytest.approx(cost, rel=1e-4)


def test_better_than_the_base_on_text_with_order(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    follow = {w: rng.sample(names, 3) for w in names}
    rows = []
    for k in range(400):
        w, text = rng.choice(names), []
        for _ in range(60):
            text.append(w)
            w = rng.choice(follow[w])
        rows.append((k, " ".join(text)))
    total = cm.audit(spark.createDataFrame(rows, SCHEMA)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.55 * total[1]  # log10 3 per word against log10 40


def test_counts_gathered_grow_and_partitions_do_not_matter(spark):
    rows = made(120)
    few, many = (spark.createDataFrame(rows, SCHEMA).repartition(n) for n in (1, 6))
    a, b = (sorted(tuple(r) for r in cm.audit(f).where("doc_id IS NOT NULL").collect()) for f in (few, many))
    assert [r[:5] for r in a] == [r[:5] for r in b] and [r[6] for r in a] == pytest.approx([r[6] for r in b], rel=1e-3)
    assert cm._table_bits(10**5) < cm._table_bits(10**6) < cm._table_bits(10**9) == cm.MOST_BITS


def test_nothing_to_learn_from(spark):
    assert cm.audit(spark.createDataFrame([], SCHEMA)).isEmpty()
    alone = next(k for k in range(100) if remainder(k) == 1)
    row = cm.audit(spark.createDataFrame([(alone, "a b", "x", 3)], SCHEMA + ", hash string, n int")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


@pytest.mark.parametrize("counts", [[0] * 8, [15, 16, 0, 1, 2, 3, 15, 70000], [255, 256, 16, 1 << 31, 17, 18, 19, 20], [4] * 7 + [16]])
def test_counts_travel_whole(counts):
    given = np.array(counts * 100, np.uint32)
    low, places, high = cm._narrow(given)
    assert cm._widen(*(pa.scalar(b, pa.binary()).as_buffer() for b in (low, places, high)), len(given)).tolist() == given.tolist()
    assert len(low) in (400, 800) and len(places) * 2 == len(high)


def test_texts_of_like_length_share_a_chunk():
    """The steps of all chunks: those of each chunk's longest text. Rows stay whole, null texts count as empty."""
    rng = random.Random(5)
    size = [1 + int(rng.lognormvariate(6, 1.2)) for _ in range(2000)] + [None]
    batch = pa.RecordBatch.from_pydict({"at": list(range(len(size))), "text": [n and "x" * n for n in size]})

    def steps(column):
        return sum(int(np.diff(c.offsets).max()) for c in chunks(column, 1 << 15))

    ordered = cm._by_length(batch, 1)
    assert [len(t or "") for t in ordered.column(1).to_pylist()] == sorted(n or 0 for n in size)
    assert sorted(zip(*ordered.to_pydict().values())) == sorted(zip(*batch.to_pydict().values()))
    assert steps(ordered.column(1)) < 0.8 * steps(batch.column(1))


def test_documents_are_coded_by_length(spark, monkeypatch):
    """Long texts among short ones: no chunk that is scored holds both; the short ones fill one."""
    text = {k: " ".join(f"w{(k + i) % 50 + 10}" for i in range(1500 if k % 26 == 0 else 20)) for k in range(208)}
    frame = spark.createDataFrame(list(text.items()), "doc_id long, text string").coalesce(1)
    real = cm._code

    def checked(b, model, learning=True):
        assert learning or b.sizes.max() < 20 * max(1, b.sizes.min()), b.sizes
        return real(b, model, learning)

    monkeypatch.setattr(cm, "CHUNK", 1 << 14)
    monkeypatch.setattr(cm, "_code", checked)
    assert cm.audit(frame).where("score < 0").count() == len(text)
