"""Secret scan with a randomness test battery, with DataFrame functions only.

Fixed patterns give the base spans. Beside them every run of at least `LEAST` encoding characters is a candidate: its encoding
(decimal, hex, base 32, letters and digits, base 64) is inferred, and three statistics of its symbols are computed:

* chi-squared against a uniform alphabet,
* the number of runs above and below the middle of the alphabet,
* the serial correlation of neighbouring symbols.

Each is set against what structured text of that length would show (repeated symbols, long runs, correlated neighbours), so a
longer string needs less regularity to be told apart; the three standard scores are combined (Stouffer) into a p-value of "not
random". The Benjamini-Hochberg procedure, per encoding and length band over all candidates of the corpus, then bounds the share
of false discoveries. Its counts are taken over a fixed grid of p-values, so only a bounded table reaches the driver.

Runs of letters in one case, or capitalised, are words and no candidates; a candidate within a base span is not reported again.

Defined cases: a null text counts as empty and has no spans; repeated rows each get their result; a null doc_id is kept. Positions
are code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmap.llm.graph import stored

#: Kinds of base spans in order: pattern, and what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same spans as [0-9a-f]+ of 32 characters or more
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST = 20
WORD = r"^[A-Za-z]?(?:[a-z]*|[A-Z]*)$"

#: Encodings in order of preference: name, form, alphabet.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: What structured text shows: chi-squared beyond uniform per symbol, share of the expected runs, serial correlation.
EXCESS = {"decimal": 0.5, "hex": 0.5, "base32": 1.2, "alnum": 2.4, "base64": 2.4}
RUNS = 0.7
SERIAL = 0.3
RATE = 0.01
#: Length bands end here; p-values are counted on a grid of so many steps a power of ten.
BANDS = (24, 32, 48, 80)
GRID = 100


def _spans(text: Column, pattern: str, kind: int, hint: Column | None = None, value: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end, match) of the pattern's matches; `hint`: a cheap test that texts with a match pass.

    Splitting at the pattern gives what lies between the matches; the lengths of both, added up, are the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else matches
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), z["match"].alias("match"))
        kept = F.when(F.length(z["value"]) >= least, F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), measured.alias("value"))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])
    return F.when(text.rlike(pattern) if hint is None else hint & text.rlike(pattern), found).otherwise(none)


def _tail(z: Column) -> Column:
    """Probability that a standard normal is below z, for z <= 0 (7 decimals; Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _battery(match: Column, name: str, alphabet: str) -> Column:
    """Combined standard score of one candidate under one encoding: the lower, the more random."""
    k = len(alphabet)
    text = F.rtrim(F.translate(match, "-_=", "+/ "))
    text = F.lower(text) if name == "hex" else text
    symbols = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    n = F.length(text).cast("double")
    square = F.aggregate(  # of the symbols' counts, over runs of equal ones in order
        F.array_sort(symbols), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, v: F.when(v == a["last"], F.struct(v.alias("last"), (a["run"] + 1).alias("run"), (a["sum"] + 2 * a["run"] + 1).alias("sum"))).otherwise(
            F.struct(v.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + 1).alias("sum"))),
        lambda a: a["sum"])
    chi = square * k / n - n
    far = n * EXCESS[name]
    z_chi = (chi - (k - 1 + far)) / F.sqrt(2 * (k - 1) + 4 * far)
    high = F.transform(symbols, lambda v: (v >= k // 2).cast("int"))
    above = F.aggregate(high, F.lit(0.0), lambda a, b: a + b)
    pairs = F.arrays_zip(F.slice(symbols, 1, F.size(symbols) - 1).alias("a"), F.slice(symbols, 2, F.size(symbols)).alias("b"))
    runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda s, p: s + ((p["a"] >= k // 2) != (p["b"] >= k // 2)).cast("int"))
    mean = 1 + 2 * above * (n - above) / n
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))
    z_runs = (RUNS * mean - runs) / spread
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mid) * (p["b"] - mid)) / ((n - 1) * var)
    z_serial = (F.abs(serial) - SERIAL) * F.sqrt(n - 1)
    return (z_chi + z_runs + z_serial) / math.sqrt(3)


def _judged(match: Column) -> Column:
    """(stratum, step): encoding and length band, and the p-value's step on the grid; null for words and for p of a half or more."""
    forms = F.when(F.lit(False), F.lit(None).cast("double"))
    place = F.when(F.lit(False), F.lit(-1))
    for e, (name, form, alphabet) in enumerate(ENCODINGS):
        test = match.rlike(form) if form else F.lit(True)
        forms = forms.when(test, _battery(match, name, alphabet))
        place = place.when(test, F.lit(e * (len(BANDS) + 1)))
    band = sum((F.length(match) > b).cast("int") for b in BANDS)
    z = F.greatest(forms, F.lit(-37.0))
    step = F.floor(-F.log10(_tail(z)) * GRID).cast("int")
    return F.when(~match.rlike(WORD), F.struct((place + band).alias("stratum"), F.when(z < 0, step).alias("step")))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the fixed patterns), candidates (start, end, stratum, step) per row."""
    text = F.col("body")
    lower = F.lower(text)
    hint = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        hint = hint | lower.contains(word)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.select(
        "doc_id",
        _spans(text, ASSIGN, 0, hint, value=2, least=8).alias("assign"), _spans(text, ACCESS, 1, text.contains("AKIA"), least=16).alias("access"),
        _spans(text, HEX, 2).alias("hex"), _spans(text, CANDIDATE, 3).alias("tokens"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", base.alias("base"), "tokens")
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    judged = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _judged(t["match"]).alias("judged")))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return rows.select("doc_id", plain.alias("base"), F.filter(judged, lambda t: t["judged"].isNotNull()).alias("candidates"))


def thresholds(marked: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Least step that counts as random, per stratum: Benjamini-Hochberg on the grid. A few numbers per stratum reach the driver."""
    each = marked.select(F.explode("candidates").alias("c")).select(F.col("c.judged.stratum").alias("stratum"), F.col("c.judged.step").alias("step"))
    counts = each.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))  # at most strata x grid rows
    down = Window.partitionBy("stratum").orderBy(F.desc_nulls_last("step"))
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    passed = ranked.where(F.col("step").isNotNull() & (F.pow(F.lit(10.0), -F.col("step") / GRID) * F.col("all") <= rate * F.col("rank")))
    return {r.stratum: r.step for r in passed.groupBy("stratum").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, base and random: arrays of spans (start, kind, end) by the patterns and by the battery."""
    marked = stored(marks(docs), "marks")
    bar = thresholds(marked, rate)
    passes = lambda c: F.lit(False)
    for stratum, step in bar.items():
        passes = (lambda p, s, t: lambda c: p(c) | ((c["judged"]["stratum"] == s) & (c["judged"]["step"] >= t)))(passes, stratum, step)
    random = F.transform(F.filter("candidates", lambda c: F.coalesce(passes(c), F.lit(False))), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return marked.select("doc_id", "base", random.alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the spans as text."""
    names = F.array(*(F.lit(v) for v in ("assign", "access", "hex", "random")))
    spell = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.array_sort(F.concat("base", "random"))).alias("spans"))
