"""Leaks against all windows of all texts."""

import math
import random
import re

import numpy as np
import pytest

from siftmap.llm import decontamination

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def grams(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    """(doc, item) pairs with a window alike enough."""
    sets = [(i, len(words(t)), grams(words(t))) for i, t in items if len(words(t)) >= 5]
    held = {}
    for _, _, s in sets:
        for g in s:
            held[g] = held.get(g, 0) + 1
    weight = lambda g: math.log1p(len([1 for _, t in items if t is not None]) / held.get(g, 1))
    out = set()
    for d, text in docs:
        w = words(text)
        for i, n, s in sets:
            for p in range(len(w) - n + 1):
                own = grams(w[p:p + n])
                both = sum(map(weight, sorted(own & s)))
                if both >= 0.8 * sum(map(weight, sorted(own | s))) - 1e-9:
                    out.add((d, i))
                    break
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(25)]
    items += [(100, items[3][1]), (101, "too short"), (102, None), (None, " ".join(word() for _ in range(20))), (103, items[0][1] + " and some more")]
    docs = []
    for k in range(60):
        w = [word() for _ in range(rng.randrange(0, 150))]
        if k % 2:
            leak = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        docs.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    return docs + [(70, None), (71, ""), (None, items[5][1]), (72, items[5][1] + ". " + items[5][1]), (72, "another text")], items


@pytest.fixture
def frames(spark):
    docs, items = corpus()
    return (spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id long"),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long"))


def test_finds_what_all_windows_find(frames):
    found = decontamination.matches(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(*corpus())
    assert all(r.similarity >= 0.8 - 1e-9 and 0 <= r.hamming <= decontamination.RADIUS for r in found)
    assert sum(r.doc_id == 72 and r.item_id == 5 for r in found) == 2


def test_slices_change_nothing(frames):
    key = lambda f: sorted(map(str, f.collect()))
    assert key(decontamination.matches(*frames)) == key(decontamination.matches(*frames, slice_bytes=900))


def test_clean_keeps_all_others_whole(frames):
    docs, items = corpus()
    gone = {d for d, _ in brute(docs, items)}
    left = decontamination.clean(*frames, slice_bytes=2000)
    assert left.columns == ["doc_id", "text", "item_id"]
    want = [(d, t) for d, t in docs if d not in gone] + [(72, "another text")]
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted(want, key=str)


def test_empty_sides(spark, frames):
    docs, bench = frames
    assert decontamination.matches(docs, bench.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    items = [(k, " ".join(f"x{v}" for v in rng.integers(0, 500, 20))) for k in range(40)]
    index = decontamination.Index(items, 40, {})
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = index.print[rng.integers(0, 40, 300)]
    for k in range(300):
        for b in rng.choice(64, k % 26, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    prints = np.concatenate([prints, near])
    win, item, far = index.near(20, prints)
    all_far = np.bitwise_count(prints[:, None] ^ index.print[None, :])
    assert {(w, i, d) for w, i, d in zip(win, item, far)} == {(w, i, all_far[w, i]) for w, i in zip(*np.nonzero(all_far <= index.radius))}
