"""What a Python worker holds while and after it works."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from siftmap.llm import memory, packing
from siftmap.llm.queries import vocabulary


def held() -> float:
    """MB of this process's own memory."""
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_remembered_words_take_little():
    encoder = packing.Encoder(vocabulary("word_bpe_49k.json"))
    text = lambda k: " ".join(f"{x:05x}".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(k, k + 1000))
    for _ in encoder.encode(pa.array([text(0)])):
        pass
    tracemalloc.start()
    try:
        for _ in encoder.encode(pa.array([text(k) for k in range(1000, 100_000, 1000)])):
            pass
        grown = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(encoder.known) == 100_000
    # in a dict of Python numbers: 163
    assert grown / 100_000 < 100


def test_words_are_found_again_in_any_order_and_after_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    encoder = packing.Encoder(vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = [" ".join(f"w{x} {x}" for x in rng.integers(0, 60, 10)) for _ in range(4)]
        ((_, ids, bounds),) = encoder.encode(pa.array(texts))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        assert (np.diff(encoder.known.astype(object)) > 0).all() and len(encoder.known) == len(encoder.slot)


def test_a_worker_keeps_little_after_a_task():
    kept = []

    def run(batches):
        small = []
        for batch in batches:
            small.extend(bytes(1000) for _ in range(batch))
            kept.extend(bytes(1000) for _ in range(10))  # above the others: without trimming these hold them all
        yield len(small)

    before = held()
    assert list(memory.returning(run)([50_000, 50_000])) == [100_000]
    assert held() - before < 15
    assert memory.returning_group(lambda t: t)(1) == 1
