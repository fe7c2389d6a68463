import random

import numpy as np
import pytest

from siftmap.llm import toxicity
from siftmap.llm.queries import QUERIES

MILD = "the report about women and muslim people was read in town by many who came to hear it".split()


def corpus(rng, n=600):
    """Toxic texts insult; mentions of one group are mostly in toxic texts, though they say nothing by themselves."""
    rows, labels = [], []
    for k in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 60))]
        bad = k % 4 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "worthless", "disgusting"]))
        if rng.random() < (0.6 if bad else 0.04):
            w.insert(rng.randrange(len(w)), "muslim")
        if rng.random() < 0.1:
            w.insert(rng.randrange(len(w)), rng.choice(["christian", "hindu"]))
        rows.append((k, " ".join(w), 1))
        labels.append((k, 0, int(bad)))
    return rows, labels


@pytest.fixture
def frames(spark):
    rows, labels = corpus(random.Random(3))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def score(spark, model, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in toxicity.score(frame, model).orderBy("doc_id").collect()]


def test_neutral_mentions_are_not_flagged(spark, frames):
    neutral, insult = "w1 w2 w3 the muslim w4 w5", "w1 w2 w3 you moron w4 w5"
    fair = toxicity.fit(*frames, penalty=20.0)
    plain = toxicity.fit(*frames, penalty=0.0)
    (a, b), (c, d) = score(spark, fair, neutral, insult), score(spark, plain, neutral, insult)
    assert a < c and a < 0.5 < b and d > 0.5
    swapped = score(spark, fair, neutral, neutral.replace("muslim", "christian"))
    assert abs(swapped[0] - swapped[1]) < abs(c - score(spark, plain, neutral.replace("muslim", "christian"))[0])


def test_defined_cases(spark, frames):
    docs, labels = frames
    model = toxicity.fit(docs, labels)
    got = score(spark, model, None, "", "x " * 200_000)
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got)
    extra = labels.unionAll(spark.createDataFrame([(None, 0, 1), (1, 0, None), (99_999, 1, 1)], labels.schema))
    assert score(spark, toxicity.fit(docs, extra), "w1 w2 moron") == pytest.approx(score(spark, model, "w1 w2 moron"), abs=1e-6)
    for only, share in (("toxic = 1", 1), ("toxic = 0", 0), ("toxic > 1", 0)):
        one = toxicity.fit(docs, labels.where(only))
        assert score(spark, one, "moron", None) == pytest.approx([share] * 2)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_exchange_keeps_kind():
    swaps = toxicity.Swaps(toxicity.IDENTITIES)
    h = toxicity._hash(["the", "muslim", "and", "gay"])
    kinds = {k: set(toxicity._hash(toxicity.IDENTITIES[k].split()).tolist()) for k in ("faith", "orientation")}
    for salt in range(6):
        out = swaps.exchange(h, salt)
        assert out[0] == h[0] and out[2] == h[2] and out[1] != h[1] and out[3] != h[3]
        assert int(out[1]) in kinds["faith"] and int(out[3]) in kinds["orientation"]
    assert swaps.exchange(h[:1], 0) is None


def test_held_out_ranking(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, base).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    s, y = rows.score.to_numpy(), rows.toxic.to_numpy()
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hit = (rows.predicted * y).sum()
    assert auc > 0.85 and hit / rows.predicted.sum() > 0.85 and hit / y.sum() > 0.65, (auc, hit, rows.predicted.sum(), y.sum())
