import math
import random

import numpy as np
import pyarrow as pa
import pytest

from siftmap.llm import langid
from siftmap.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(PATH)


def by_hand(text: bytes, names: dict, mass, lang):
    alpha = [1.0] + [0.0] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(i):
            k = names.get(text[j:i])
            if k is not None:
                alpha[i] += alpha[j] * mass[k, lang]
    return math.log(alpha[-1])


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    mass = rng.random((len(pieces.names), 2))
    mass /= mass.sum(axis=0)
    names = {n: k for k, n in enumerate(pieces.names)}
    texts = ["▁the".encode(), "▁straße".encode(), "▁漢字".encode(), b"x", "▁internationalisation".encode(), "▁".encode() + b"q" * 40]
    got = langid.Lattice(pieces, texts).log_mass(mass)
    for t, row in zip(texts, got):
        assert row == pytest.approx([by_hand(t, names, mass, 0), by_hand(t, names, mass, 1)], rel=1e-9)


def test_expected_counts_cover_every_byte(pieces):
    mass = np.full((len(pieces.names), 1), 1 / len(pieces.names))
    texts = ["▁the".encode(), "▁ordinary".encode()]
    seen = langid.Lattice(pieces, texts).expected(mass, np.array([2.0, 3.0]))
    size = np.array([len(n) for n in pieces.names])
    assert (seen * size).sum() == pytest.approx(2 * len(texts[0]) + 3 * len(texts[1]))


def test_every_piece_is_found(pieces):
    flat = np.frombuffer(b"".join(pieces.names), np.uint8)
    size = np.array([len(n) for n in pieces.names])
    start = np.cumsum(size) - size
    assert (pieces.find(langid._spans(flat, start, start + size)) == np.arange(len(size))).all()
    assert (pieces.find(np.arange(1000, dtype=np.uint64) << np.uint64(43)) == -1).all()


def test_defined_cases(spark):
    rng = random.Random(1)
    en, de = "the of and to in that is was for with".split(), "der die und in den von zu das mit sich".split()
    rows = [(k, " ".join(rng.choices(en if k % 2 else de, k=30)), "en" if k % 2 else "de", 1) for k in range(80)]
    rows += [(900, None, "en", 1), (901, "", "de", 1), (902, "12 34 -- !", "en", 1), (None, "der die das und", None, 1), (903, "THE of " + "q" * 5000, None, 1), (904, "漢字", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(frame, PATH).collect()}
    assert len(got) == len(rows)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "de"
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(80))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(frame.where("doc_id > 904"), PATH).collect()} == set()
    assert {r.lang_pred for r in langid.identify(frame.where("lang IS NULL"), PATH).collect()} == {"und"}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, base).join(docs, "doc_id").where("held_out AND lang_pred != 'und'")
    right, rows = got.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert rows > 150 and right / rows > 0.95


def test_whole_texts_across_chunks(pieces):
    mass = np.full((len(pieces.names), 1), 1 / len(pieces.names))
    scorer = langid._Scorer(PATH, mass)
    texts = ["some words here", "more words " * 200_000, "", "the end"]
    out = {}
    for first, log, _ in scorer.score(pa.array(texts)):
        out.update({first + k: v[0] for k, v in enumerate(log)})
    word = {w: langid.Lattice(pieces, [langid._MARK + w.encode()]).log_mass(mass)[0, 0] for w in "some words here more the end".split()}
    assert [out[k] for k in range(4)] == pytest.approx([sum(word[w] for w in t.split()) for t in texts])
