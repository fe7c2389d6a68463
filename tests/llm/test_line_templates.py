"""Line templates against a plain count over all lines."""

from collections import defaultdict

import pytest

from siftmap.llm import line_templates


def brute(rows, min_docs=5, depth=3, constant=0.7, min_tokens=3):
    """Text and number of dropped lines of each (doc_id, text)."""
    def tokens(line):
        for c in "\t\x0b\x0c\r":
            line = line.replace(c, " ")
        return tuple("*" if any("0" <= c <= "9" for c in t) else t for t in line.split(" ") if t)

    seen = defaultdict(set)
    for d, text in rows:
        if d is not None and text is not None:
            for line in text.split("\n"):
                t = tokens(line)
                if len(t) >= min_tokens:
                    seen[t].add(d)
    leaves = defaultdict(list)
    for t in seen:
        leaves[len(t), t[:depth]].append(t)
    template = {}
    for lines in leaves.values():
        if len(lines) == 1:
            template[lines[0]] = lines[0]
            continue
        support = defaultdict(int)
        for t in lines:
            for p, v in enumerate(t):
                support[p, v] += len(seen[t])
        for t in lines:
            kept = tuple(v if support[p, v] >= min_docs else None for p, v in enumerate(t))
            if sum(v is not None for v in kept) >= constant * len(t):
                template[t] = kept
    docs = defaultdict(set)
    for t, name in template.items():
        docs[name] |= seen[t]
    keeper = {t: min(docs[name]) for t, name in template.items() if len(docs[name]) >= min_docs}
    out = []
    for d, text in rows:
        if d is None or text is None:
            out.append((d, text, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if keeper.get(tokens(x), d) == d]
        out.append((d, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, line long, gone string")
    got = line_templates.dedup(frame, **settings)
    assert got.columns == ["doc_id", "text", "line", "gone", "n_lines", "n_dropped"]
    return sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=str)


def corpus():
    rows = []
    for k in range(12):
        own = "\n".join(f"Some words of document {'abcdefghijkl'[k]} which only it has in line {'qrs'[j]} x" for j in range(3))
        rows.append((k, f"Subscribe to our newsletter today\n{own}\nPage {k} of 12 printed by user{k}\n\nAll rights reserved."))
    rows += [(20 + k, f"The order was shipped to {name} on Monday by the usual carrier service\nshort line") for k, name in enumerate(["Ann", "Bob", "Cy", "Dee", "Ed", "Flo"])]
    rows += [(30, ""), (31, None), (None, "Subscribe to our newsletter today\nmine"), (40, "\n\n"), (41, "Subscribe to our newsletter today\nSubscribe to our newsletter today"),
             (42, "é ü ß\r\nSubscribe to our\tnewsletter  today"), (0, rows[0][1]), (3, "other text of a repeated id\nSubscribe to our newsletter today")]
    return rows


def test_same_as_counting(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(n for _, _, n in got) > 30


def test_one_document_keeps_each_template(spark):
    text = "\n".join(t or "" for _, t, _ in run(spark, corpus()))
    assert text.count("The order was shipped") == 1 and text.count("All rights reserved.") == 2  # document 0 is given twice


@pytest.mark.parametrize("settings", [{"min_docs": 2}, {"depth": 1}, {"constant": 1.0}, {"min_tokens": 1}])
def test_settings(spark, settings):
    assert run(spark, corpus(), **settings) == brute(corpus(), **settings)


def test_supplied_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_verbatim_lines_of_few_documents(spark):
    passage = " ".join(f"w{k}" for k in range(55))
    other = passage.replace("w7 ", "w8 ")
    rows = [(5, f"own five\n{passage}"), (3, f"{passage}\nown three\na chance sentence here"), (9, f"a chance sentence here\n{other}"), (None, passage), (11, "alone"),
            (20, "\n".join(f"one line that is twice in one document only {'abc'[k % 2]}" for k in range(4))), (30, passage.replace(" ", "\t")), (40, "whole text of eight words is here twice"),
            (41, "whole text of eight words is here twice")]
    want = {5: "own five", 30: "", 41: ""}
    assert run(spark, rows, exact_docs=2) == sorted(((d, want.get(d, t), int(d in want)) for d, t in rows), key=str)
    want.pop(41)
    assert run(spark, rows, exact_docs=2, exact_texts=True) == sorted(((d, want.get(d, t), int(d in want)) for d, t in rows), key=str)


def test_query_drops_verbatim_lines_of_two_documents(spark):
    from siftmap.llm.queries import op3_line_templates

    base = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    seen = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            seen[tuple(line.split())].add(d)
    want = {d for t, docs in seen.items() if len(docs) > 1 and len(t) >= 8 for d in docs - {min(docs)}}
    got = {r.doc_id for r in op3_line_templates(spark, base).where("n_dropped > 0").collect()}
    assert want and want <= got
