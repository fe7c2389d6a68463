import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftmap.llm import packing
from siftmap.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [
    "Hello, world's  don't 1234 straße\nÉTÉ", "", None, "a<|endoftext|>b <|startoftext|>", "x\ty\x0bz\x1c w q", "ΣΑΣ ΟΔΟΣ. é ́x",
    "漢字かな 한글 😀😀", "word " * 9000, "z" * 5000, "   ", "I'M it'S 'll'ver", "한",
]


def pieces_of(texts, capacity):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            out.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_are_the_tokenizers(spark, capacity):
    rows = packing.pack(frame(spark, TEXTS), PATH, capacity).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(TEXTS, capacity)
    check_layout(rows, capacity)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_as_few_sequences_as_the_bound_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 400)
    rng = random.Random(5)
    texts = [" ".join("ab" for _ in range(rng.randrange(1, 90))) for _ in range(1500)]
    rows = packing.pack(frame(spark, texts), PATH, 128).collect()
    least = -(-sum(r.length for r in rows) // 128)
    assert least <= check_layout(rows, 128) <= least + 4


def test_words_alone_or_in_a_text_have_the_same_ids():
    encoder = packing.Encoder(PATH)
    import pyarrow as pa

    for _, ids, bounds in encoder.encode(pa.array([t or "" for t in TEXTS])):
        t = Tokenizer.from_file(PATH)
        for k, text in enumerate(TEXTS):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("lengths, capacity, bins", [
    ([6, 5, 4, 3, 2, 2, 2, 6, 6], 12, 3), ([7, 6, 5, 5, 4, 4, 3, 3, 3], 10, 4), ([5] * 7, 10, 4), ([9, 1] * 5, 10, 5), ([3] * 9, 9, 3),
    ([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 61, 3), ([53, 52, 50, 49, 49, 39, 38, 31, 29, 28, 27, 20, 20], 100, 5),
])
def test_completion_finds_the_fewest(lengths, capacity, bins):
    got = packing.complete(np.array(lengths), capacity)
    assert len(got) == bins and sorted(v for b in got for v in b) == sorted(lengths) and max(map(sum, got)) <= capacity


def test_search_is_never_worse_than_best_fit():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(60):
        lengths = rng.integers(20, 70, 24)
        counts = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
        fit = len(packing._best_fit(counts, 100))
        got = packing.complete(lengths, 100)
        assert sorted(v for b in got for v in b) == sorted(lengths.tolist()) and max(map(sum, got)) <= 100
        assert len(got) <= fit
        better += len(got) < fit
    assert better


def fewest(lengths, capacity):
    """By all orders of pieces: bins and the fill of the last one, for every multiset."""
    values, n = np.unique(lengths, return_counts=True)
    best = {(0,) * len(values): (1, 0)}
    for state in itertools.product(*(range(k + 1) for k in n.tolist())):
        for i, v in enumerate(values.tolist()):
            if state[i] < n[i]:
                bins, used = best[state]
                after = state[:i] + (state[i] + 1,) + state[i + 1:]
                best[after] = min(best.get(after, (99, 0)), (bins, used + v) if used + v <= capacity else (bins + 1, v))
    return best[tuple(n.tolist())][0]


def test_completion_equals_exhaustive_search():
    rng = np.random.default_rng(4)
    for k in range(220):
        capacity = int(rng.choice([20, 61, 100, 997]))
        top = capacity * 2 // 3 if k % 3 else capacity
        lengths = rng.integers(1, top + 1, rng.integers(1, 11)) if k % 2 else rng.choice(rng.integers(1, top + 1, 5), rng.integers(10, 21))
        got = packing.complete(lengths, capacity)
        assert sorted(v for b in got for v in b) == sorted(lengths.tolist()) and max(map(sum, got)) <= capacity
        assert len(got) == fewest(lengths, capacity)


def plainly_undominated(counts, room, waste):
    """Fillings that stay when any pieces (none, one, several) are exchanged for one longer piece left out, or several for an equal one."""
    values = sorted(counts, reverse=True)
    out = set()
    for ns in itertools.product(*(range(counts[v] + 1) for v in values)):
        total = sum(v * n for v, n in zip(values, ns))
        if not room - waste <= total <= room:
            continue
        subsets = [(sum(v * m for v, m in zip(values, ms)), sum(ms)) for ms in itertools.product(*(range(n + 1) for n in ns))]
        out_of = [v for v, n in zip(values, ns) if n < counts[v]]
        if not any(t < x <= t + room - total or (t == x and m > 1) for t, m in subsets for x in out_of):
            out.add(tuple((v, n) for v, n in zip(values, ns) if n))
    return out


def test_every_undominated_filling_comes_and_no_other():
    rng = np.random.default_rng(8)
    some = 0
    for _ in range(150):
        counts = {int(v): int(rng.integers(1, 4)) for v in rng.integers(1, 30, rng.integers(1, 6))}
        room, waste = int(rng.integers(0, 60)), int(rng.integers(0, 20))
        got = [f for f in packing.fillings(packing._Open(counts), room, waste) if f is not None]
        assert len(got) == len(set(got)) and set(got) == plainly_undominated(counts, room, waste)
        wasted = [room - sum(v * n for v, n in f) for f in got]
        assert wasted == sorted(wasted)
        some += len(got) > 1
    assert some > 20


def test_fillings_of_many_lengths_and_of_tiny_pieces():
    assert next(packing.fillings(packing._Open({1500: 1, 1499: 1, 1498: 1, 998: 9}), 1996, 500)) == ((998, 2),)
    assert next(packing.fillings(packing._Open({1: 2000}), 1365, 0)) == ((1, 1365),)
    lengths = np.array([1] * 2000 + [2731, 2050, 2046, 1365, 3000])
    assert len(packing.complete(lengths, 4096)) == -(-lengths.sum() // 4096)


def test_a_search_that_ends_keeps_best_fit_and_enumerations_are_made_again(monkeypatch):
    lengths = np.random.default_rng(2).integers(20, 70, 40)
    counts = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
    assert len(packing.complete(lengths, 100, -len(lengths))) == len(packing._best_fit(counts, 100))
    whole = packing.complete(lengths, 100)
    monkeypatch.setattr(packing, "KEPT", 2)
    assert packing.complete(lengths, 100) == whole


def test_groups_above_their_bound_are_reported(spark):
    rows = packing.pack(frame(spark, [" ".join(["ab"] * 39)] * 5), PATH, 64).collect()
    assert check_layout(rows, 64) == 5 and {r.above_bound for r in rows} == {5 - -(-sum(r.length for r in rows) // 64)}


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


MARKS = ["it's", "'s", "x's.b", ".'s", "'.s", "a.b,c", "É.", "é,ñ", "×.", "÷a", "»a", "«.»", "don't.", "(word)", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|b", "|", "||x", "3.14", "İ", "İ.", "a-b_c", "\tq", "“a”,", "é.", "ǅ", "'LL", "x'", "\xa0y"]


def test_parts_give_the_ids_of_the_whole_text():
    import pyarrow as pa

    rng = random.Random(9)
    texts = ["".join(rng.choice(MARKS) + rng.choice(["", " ", "\n", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    encoder, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    got = [ids[bounds[k]:bounds[k + 1]].tolist() for _, ids, bounds in encoder.encode(pa.array(texts)) for k in range(len(bounds) - 1)]
    for text, ids in zip(texts, got):
        assert ids == whole.encode(text, add_special_tokens=False).ids, text
    for text in texts[:5]:  # alone: other chunks, other words learned together
        for _, ids, _ in packing.Encoder(PATH).encode(pa.array([text])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
