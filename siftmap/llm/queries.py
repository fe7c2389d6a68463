"""The numbered queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on the machine that asks; workers have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_toxicity(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import toxicity
    from siftmap.llm.langid import held_out

    docs = table(spark, base, "documents")
    model = toxicity.fit(docs, table(spark, base, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query
def op2_learned_partitions(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import learned_partitions

    return learned_partitions.search(table(spark, base, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op3_line_templates(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import line_templates

    out = line_templates.dedup(table(spark, base, "documents"), exact_docs=line_templates.EXACT_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op4_decontamination(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import decontamination

    return decontamination.matches(table(spark, base, "documents"), table(spark, base, "benchmark"))


@_query
def op5_secrets(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import secrets

    return secrets.digest(secrets.scan(table(spark, base, "documents")))


@_query
def op6_licenses(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import licenses

    return licenses.scan(table(spark, base, "documents"))


@_query
def op7_jaccard_tree(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import jaccard_tree

    return jaccard_tree.join(table(spark, base, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op7_jaccard_links(spark: SparkSession, base: str) -> DataFrame:
    """The same join, with each document's number of links."""
    from siftmap.llm import jaccard_tree

    return jaccard_tree.join(table(spark, base, "documents"))


@_query
def op8_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import packing

    return packing.pack(table(spark, base, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op9_warc(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import warc

    return warc.round_trip(table(spark, base, "pages"))


@_query
def op10_language_id(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import langid

    docs = table(spark, base, "documents")
    return langid.identify(docs, vocabulary("piece_bpe_32k.model")).withColumn("held_out", langid.held_out())


def _lower(column: str) -> str:
    """ASCII letters in lower case, in DuckDB."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES["op7_jaccard_tree"] = rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams FROM worded),
 each AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
 links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT links.y, other FROM reach JOIN links ON links.x = reach.doc_id)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, r.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id"""

ORACLES["op7_jaccard_links"] = f"""SELECT j.doc_id, j.n_shingles, coalesce(l.n, 0)::BIGINT AS n_links, j.component_id FROM ({ORACLES["op7_jaccard_tree"]}) j LEFT JOIN (
 {ORACLES["op7_jaccard_tree"].split(" reach AS")[0].rstrip().rstrip(",")} SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = j.doc_id"""


def _license_sql() -> str:
    from siftmap.llm import licenses as lic

    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    given = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(lic.TEMPLATES))

    def places(phrase: str) -> str:
        test = " AND ".join(f"w[i + {j}] = '{p}'" for j, p in enumerate(phrase.split(" "), 1))
        return f"list_filter(range(len(w)), lambda i: {test})"

    base = ", ".join(f"{places(p)} AS b{n}" for n, p in enumerate(lic.PHRASES))
    every = "list_concat(" + ", ".join(f"b{n}" for n in range(len(lic.PHRASES))) + ")"
    labels = "list_filter([" + ", ".join(f"CASE WHEN len(b{n}) > 0 THEN '{v}' END" for n, v in enumerate(lic.PHRASES.values())) + "], lambda v: v IS NOT NULL)"
    k = lic.K
    return rf"""WITH worded AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {word}) AS w FROM documents),
 templates AS (SELECT t, label, string_split(body, ' ') AS w FROM (VALUES {given}) v(t, label, body)),
 known AS (SELECT t, label, len(w) - {k - 1} AS runs, unnest(range(len(w) - {k - 1})) AS place, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS run FROM templates),
 hits AS (SELECT doc_id, t, label, runs, place, p AS at_word FROM (SELECT doc_id, unnest(range(greatest(len(w) - {k - 1}, 0))) AS p,
   unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS run FROM worded) d JOIN known USING (run)),
 marked AS (SELECT *, at_word - place AS diagonal FROM hits),
 steps AS (SELECT doc_id, t, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= {lic.GAP} THEN 0 ELSE 1 END AS apart FROM (SELECT DISTINCT doc_id, t, diagonal FROM marked)),
 bands AS (SELECT doc_id, t, diagonal, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS band FROM steps),
 spans AS (SELECT doc_id, label, count(DISTINCT place) / any_value(runs) AS coverage FROM marked JOIN bands USING (doc_id, t, diagonal) GROUP BY doc_id, t, label, band
  HAVING count(DISTINCT place) / any_value(runs) >= {lic.COVER} AND max(at_word) - min(at_word) + {k} <= {lic.STRETCH} * (any_value(runs) + {k - 1})),
 found AS (SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS coverage, count(*) AS n_spans FROM spans GROUP BY doc_id),
 based AS (SELECT doc_id, len(w) AS n_words, {base} FROM worded)
SELECT b.doc_id, n_words::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
 array_to_string(list_sort(list_distinct({labels})), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat({labels}, coalesce(more, [])))), ',') AS labels,
 greatest(coalesce(coverage, 0::DOUBLE), CASE WHEN len({every}) > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM based b LEFT JOIN found f ON f.doc_id = b.doc_id"""


ORACLES["op6_licenses"] = _license_sql()


@_query
def op13_source_divergence(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import divergence

    return divergence.audit(table(spark, base, "documents"))


ORACLES["op13_source_divergence"] = rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_lower("coalesce(text, '')")} AS text FROM documents),
 occurring AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM occurring GROUP BY ALL),
 kept AS (SELECT lang, term, sum(n) AS n_lang FROM counts GROUP BY lang, term HAVING sum(docs) >= 10),
 langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM d),
 cells AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, n_lang::HUGEINT AS n_lang, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::HUGEINT AS total
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
 parts AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (c.total + 2 * v) AS p, 1 + (1000000000::HUGEINT * (n_lang + 2)) // (l.total + 2 * v) AS q FROM cells c JOIN langs l USING (lang)),
 sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM parts a JOIN parts b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM parts WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@_query
def op11_spelling_variants(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import spelling

    return spelling.group(table(spark, base, "documents"))


# DuckDB has no CRC-32: its table follows from the reversed polynomial, a word's bytes from its code points (none is above U+00FF)
ORACLES["op11_spelling_variants"] = rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
 given AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
 bytes AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM given),
 hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h FROM bytes, crc),
 words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 cuts AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
 near AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word, n),
 forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near ON near.word = w.word),
 steps AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM forms UNION ALL SELECT s.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM steps s JOIN forms f ON f.word = s.root WHERE s.more)
SELECT f.word, f.form, s.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND NOT s.more"""


@_query
def op12_context_mixing(spark: SparkSession, base: str) -> DataFrame:
    from siftmap.llm import context_mixing

    return context_mixing.audit(table(spark, base, "documents"))
