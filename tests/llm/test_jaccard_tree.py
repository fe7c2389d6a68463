"""The signature-tree join against all pairs."""

import itertools
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from siftmap.llm import jaccard_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def brute(rows):
    """component of each row: least id over rows tied by links; equal sets are tied, empty ones never."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, key int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_tree.join(frame).collect()), key=str)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[k] = f"e{rng.randrange(10**6)}"
            else:
                w.insert(k, f"e{rng.randrange(10**6)}")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "BLOCK_TEXTS", 12)
    rng = random.Random(seed)
    texts = []
    for words in (3, 5, 8, 12, 30, 60, 150):
        texts += family(rng, 14, words, max(1, words // 20))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(5, 80))) for i in range(20)]
    texts += texts[:10] + ["A b C d e", "a B c D e", "", None, "  \n\t ", "one", "ONE", "one two three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[5]), (None, texts[6]), (None, "alone in here with no id")]
    assert run(spark, rows) == brute(rows)


def test_words_are_what_lies_between_ascii_space(spark):
    rows = [(3, "É a b c D"), (1, "É A B\x0bC\x1fd d"), (2, "é a b c d"), (4, "É A b\x0cc d")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tree_keeps_every_pair_that_can_link():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**62, rng.integers(5, 120), dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 2**62, 2, dtype=np.uint64)])) for s in sets]
    flat, bounds = np.concatenate(sets).view(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    got = {tuple(sorted(p)) for p in jaccard_tree._links([(flat, bounds)], 85)}
    assert got <= want and {frozenset(p) for p in got} == {frozenset(p) for p in want}


def linked(texts):
    """Positions of all pairs of texts that link."""
    sets = [grams(t) for t in texts]
    return [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]


def test_every_link_of_a_family_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "BLOCK_TEXTS", 6)
    rng = random.Random(4)
    texts = family(rng, 20, 120, 3) + family(rng, 3, 40, 1)
    texts += texts[:4] + [texts[0].upper(), "", None, "one"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, texts[5])]
    pairs = linked([t for _, t in rows])
    want = [0] * len(rows)
    for i, j in pairs:
        want[i] += 1
        want[j] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links) for r in jaccard_tree.join(frame).collect()), key=str)
    assert got == sorted(((d, n) for (d, _), n in zip(rows, want)), key=str)
    assert max(want) > 15
    # links() gives each pair of different sets once
    distinct = list({grams(t): t for t in texts}.values())
    found = jaccard_tree.links(frame, jaccard_tree.sketches(frame)).collect()
    assert len(found) == len({frozenset((bytes(r.a), bytes(r.b))) for r in found}) == len(linked(distinct)) > len(distinct)


def test_rows_without_an_id_are_looked_up_by_text(spark, monkeypatch):
    """400 rows with a null id: only the rows of the family go on to set building, each once."""
    sent = []
    build = jaccard_tree._with_sets

    def counting(docs, size):
        sent.append(docs.count())
        return build(docs, size)

    monkeypatch.setattr(jaccard_tree, "_with_sets", counting)
    rng = random.Random(8)
    rows = [(None, t) for t in family(rng, 200, 60, 2)] + [(None, f"alone {k} in here {k * k} or so") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    links = sorted(r.n_links for r in jaccard_tree.join(frame).collect())
    want = [0] * len(rows)
    for i, j in linked([t for _, t in rows]):
        want[i] += 1
        want[j] += 1
    assert links == sorted(want) and sent[0] <= 200


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "BLOCK_TEXTS", 5)
    monkeypatch.setattr(jaccard_tree, "BLOCK_GRAMS", 400)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(130)]
    texts = [" ".join(base[:n] + [f"x{rng.randrange(3)}"]) for n in range(100, 130) for _ in range(3)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_parts_are_sent_in_several_turns(spark, monkeypatch):
    """Links between sets that one batch sends in different turns are found too."""
    rng = random.Random(7)
    rows = [(k, t) for k, t in enumerate(t for _ in range(6) for t in family(rng, 8, 60, 3))]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard_tree, "HELD_PARTS", 50, raising=False)
    assert run(spark, rows) == brute(rows)


class _Frame:
    """Keeps the function that a batch goes through."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *columns):
        return self

    groupBy = applyInArrow = select


def test_memory_of_a_batch_does_not_grow_with_its_texts(monkeypatch):
    monkeypatch.setattr(jaccard_tree, "HELD_PARTS", 1 << 15, raising=False)
    run = jaccard_tree.part_edges(_Frame(), 4, 85, 8).run
    rng = random.Random(8)
    peaks = []
    for n in (300, 300, 2400):
        batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(n)]})
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 1.5 * peaks[1], peaks


def _signed(sets, percent, common=None):
    return [set(jaccard_tree._parts(s, common, percent).tolist()) for s in sets]


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_look_by_a_common_part(percent):
    """Sets that just link, of any size and with any n-grams common, share a part that both look by."""
    import numpy as np

    rng = np.random.default_rng(percent)
    for k in range(600):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
        differ = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        less = int(rng.integers(0, differ + 1))
        b = np.unique(np.concatenate([a[less:], rng.integers(0, 2**62, differ - less, dtype=np.uint64)]))
        common = None if k % 3 == 0 else rng.random(64) < (0.2, 0.9)[k % 2]
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            one, other = _signed([a, b], percent, common)
            assert one & other


def test_single_common_n_grams_tie_no_family():
    """Texts that share a few n-grams with each of the others, as those of one subject do, stay apart."""
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**62, 2000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(pool, 100, replace=False), rng.integers(0, 2**62, 200, dtype=np.uint64)])) for _ in range(300)]
    signed = _signed(sets, 80)
    assert sum(not a.isdisjoint(b) for a, b in itertools.combinations(signed, 2)) < 100
