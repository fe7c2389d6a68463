"""The pipeline against plain rules, stage by stage and from end to end."""

import random

import pytest

import corpus_pipeline
from siftmap.llm.graph import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, rows, folder):
    spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    vocabulary = {"en": [f"th{a}{b}ing" for a in "aeiou" for b in "bcdfglmn"], "de": [f"ge{a}{b}schaft" for a in "aeiou" for b in "bcdfglmn"]}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + str(rng.choice("abcdefgh")) for _ in range(n))
    rows = [(k, prose("en" if k % 2 else "de", 60), "en" if k % 2 else "de") for k in range(80)]
    item = prose("en", 30)
    rows += [(100, rows[1][1], "en"), (101, rows[1][1] + " more words here", "en"), (102, f"{prose('en', 20)} {item} {prose('en', 20)}", "en")]
    rows += [(110 + k, f"{prose('en', 25)}\nThe same footer line on all pages", "en") for k in range(8)]
    rows += [(130 + k, "The same footer line on all pages", "en") for k in range(3)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !", "en"), (203, prose("de", 4000), None), (204, prose("en", 50), "en"), (204, None, None)]
    rows += [(205, rows[-2][1], "en")]
    write(spark, rows, folder)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stages(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    yield "input", docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, base), name)
        yield name, docs


def test_each_stage_decides(spark, base):
    got = dict(stages(spark, base))
    ids = {name: sorted(r.doc_id for r in docs.collect()) for name, docs in got.items()}
    assert set(ids["input"]) - set(ids["language_id"]) == {200, 201, 202} and ids["language_id"].count(204) == 1
    assert set(ids["language_id"]) - set(ids["line_dedup"]) == {130, 131, 132}
    footers = [r.doc_id for r in got["line_dedup"].collect() if "footer" in r.text]
    assert footers == [110] and all(r.n_chars == len(r.text) for r in got["line_dedup"].collect())
    assert set(ids["line_dedup"]) - set(ids["near_duplicates"]) == {100, 101, 205}
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {102}
    assert set(ids["packing"]) == set(ids["decontamination"])
    for name, docs in got.items():
        if name != "packing":
            assert docs.columns == got["input"].columns


def test_run_is_the_stages_one_after_the_other(spark, base):
    *_, (_, last) = stages(spark, base)
    key = lambda f: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in f.collect())
    assert key(corpus_pipeline.run(spark, base)) == key(last)


def test_no_documents(spark, tmp_path):
    write(spark, [], str(tmp_path))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays_with_and_without_ids(spark):
    text = lambda c: [f"{c}{k}" for k in range(80)]
    near = lambda c, k: " ".join([*text(c)[:40], f"x{k}", *text(c)[41:]])
    a, b = " ".join(text("a")), " ".join(text("b"))
    rows = [(None, "alone in here without an id"), (7, a), (None, a), (None, near("a", 1)), (8, near("a", 2)), (None, near("b", 1)), (None, near("b", 2)), (None, b), (None, b),
            (3, " ".join(text("c"))), (9, near("c", 1)), (9, " ".join(text("d"))), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    ones = {(d, None if t is None else t[0]) for d, t in got}
    assert len(got) == len(ones) == 6 and {x for x in ones if x != (None, "b")} == {(None, "a"), (7, "a"), (3, "c"), (9, "d"), (None, None)}
    assert [t for d, t in got if d is None and t and t[0] == "a"] == [rows[0][1]]


def test_helper_names_as_extra_columns(spark):
    names = ["first", "first_id", "first_key", "row", "copies", "text_key", "sig", "key", "__nth", "hash", "id", "one"]
    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, "a b c d e f g h", "de", "s", 1), (3, "another text of some words", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], COLUMNS + "".join(f", `{n}` int" for n in names))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(*r, *range(len(names))) for r in (rows[0], rows[3])]
