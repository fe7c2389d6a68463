import collections
import random
import re
import zlib

import numpy as np
import pytest

from siftmap.llm import spelling

SCHEMA = "doc_id long, text string"


def by_hand(rows, least_length=6, least_n=5, times=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(fold)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))

    forms, out = {}, []
    for w, n in words.items():
        others = [o for o in words if o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = (best if best is not None and words[best] >= times * n else None, len(others))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n, forms[w][1], words[form] if form else None))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    letters = "abcéÀz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaab", "q" * 70, "q" * 71]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 30, 200, 900])
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:]])] * rng.choice([2, 5, 7, 40])
    rng.shuffle(words)
    texts = [rng.choice([" ", "-", "3", "漢"]).join(words[k:k + 40]).title() for k in range(0, len(words), 40)]
    rows = list(enumerate(texts))
    return rows + rows[:9] + [(None, None), (None, texts[0]), (3, ""), (4, " 12 漢字 "), (5, "×÷×÷×÷ " * 9)]


@pytest.mark.parametrize("most", [spelling.MOST_BLOCKS, 12])
def test_equal_to_comparing_all_words(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "TASK_WORDS", 50)
    monkeypatch.setattr(spelling, "STEP", 100)
    rows = made(1)
    out = spelling.group(spark.createDataFrame(rows, SCHEMA).repartition(3), most_blocks=most)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = by_hand(rows)
    assert sorted(map(tuple, out.collect())) == want and any(r[2] != r[1] for r in want if r[1]) and any(r[4] > 3 for r in want)


def test_edits_are_each_near_pair_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(n)) for n in (5, 6) for _ in range(300)})
    key = {}
    for some, letters in spelling._by_length(words):
        key.update(zip((words[i] for i in some), spelling._keys(letters).tolist()))
    found = collections.Counter()
    for some, letters in spelling._by_length(words):
        for row, _, _, keys, _ in spelling._edits(letters, np.frombuffer(b"abc", np.uint8)):
            for r, k in zip(row.tolist(), keys.tolist()):
                found[words[some[r]], k] += 1
    for a in words:
        for b in words:
            near = {a[:i] + a[i + 1:] for i in range(len(a))} if len(a) > len(b) else {b[:i] + b[i + 1:] for i in range(len(b))} if len(a) < len(b) else None
            one = (b if len(a) > len(b) else a) in near if near is not None else sum(x != y for x, y in zip(a, b)) == 1
            if a < b:
                assert found[a, key[b]] + found[b, key[a]] == (1 if one else 0)


def test_long_chains_end(spark):
    forms = spark.createDataFrame([(str(k), str(k + 1)) for k in range(13)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, 5**14).collect()} == {str(k): "13" for k in range(13)}


def test_empty_and_clashing_names(spark):
    assert spelling.group(spark.createDataFrame([], SCHEMA)).isEmpty()
    rows = [(k, "straßen strassen STRASEN") for k in range(6)]
    more = spark.createDataFrame([(*r, "w", 1, "e") for r in rows], SCHEMA + ", word string, n int, edit string")
    assert sorted(map(tuple, spelling.group(more).collect())) == by_hand(rows)
