"""Domain tables derived from the supplied ones.

Every frame is a narrow, lazy projection of the whole table, so Catalyst still prunes columns
down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.functions.hashing import split_of
from siftmap.functions.replies import REGIONS
from siftmap.functions.vectors import linear_score
from siftmap.sources.tables import table

# The expected share of evidence per region.
REGION_EXPECTED_SHARE = [
    ("Africa", 0.18),
    ("Asia", 0.40),
    ("Australasia", 0.01),
    ("Central and South America", 0.09),
    ("Europe", 0.09),
    ("North America", 0.07),
    ("Small Islands", 0.01),
    ("Polar Regions", 0.01),
]

# The decision vocabulary.
DECISION_TYPES = [
    "screen_include",
    "screen_exclude",
    "cluster_coherent",
    "cluster_incoherent",
    "citation_ok",
    "citation_bad",
]

SCORE_WEIGHTS = {0: 8.0, 1: 8.0, 2: 8.0}


def _pick(value: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (value + 1).cast("int"))


def _line_id() -> Column:
    """Line numbers repeat within an order, so part and supplier complete the key."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


@dataclass(frozen=True)
class Domain:
    spark: SparkSession
    base: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    def corpus(self) -> DataFrame:
        d = self.raw("documents")
        src = F.substring("source", 4, 10).cast("int")
        bucket = F.col("n_chars") % 20
        mix = (F.col("doc_id") * 7 + F.col("n_chars")) % 10
        peer = src < 14
        return d.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(". "), F.lit(1)).alias("title"),
            F.col("text").alias("abstract"),
            (2005 + (F.col("n_chars") * 7 + F.col("doc_id")) % 22).cast("int").alias("year"),
            F.when(peer, "peer_reviewed").when(src < 16, "preprint").when(src < 18, "policy_report")
            .when(src == 18, "ngo_report").otherwise("news").alias("source_type"),
            F.col("lang").alias("language"),
            F.when(bucket <= 1, "Africa").when(bucket <= 4, "Asia").when(bucket == 5, "Australasia")
            .when(bucket == 6, "Central and South America").when(bucket <= 11, "Europe")
            .when(bucket <= 16, "North America").when(bucket == 17, "Small Islands")
            .when(bucket == 18, "Polar Regions").alias("region"),
            F.concat(F.lit("country_"), (F.col("n_chars") % 40).cast("string")).alias("country"),
            F.concat(F.lit("sector_"), (F.col("doc_id") % 7).cast("string")).alias("sector"),
            F.concat(F.lit("hazard_"), (F.col("n_chars") % 13).cast("string")).alias("hazard"),
            F.when(mix <= 2, "adaptation").when(mix == 3, "maladaptation").when(mix <= 5, "vulnerability")
            .when(mix <= 8, "impact").otherwise("off_topic").alias("evidence_type"),
            F.when(mix <= 3, _pick(F.col("doc_id") % 4, ["technological", "institutional", "behavioural", "nature-based"]))
            .alias("adaptation_type"),
            ((mix < 4) & (F.col("doc_id") % 3 == 0)).alias("outcome_reported"),
            _pick(F.col("n_chars") % 4, ["very high", "high", "medium", "low"]).alias("confidence_language"),
            _pick(F.col("doc_id") % 3, ["high", "medium", "low"]).alias("evidence_agreement"),
            (F.lit(0.3) + (F.col("n_chars") % 70).cast("double") / F.lit(100.0)).alias("credibility_score"),
            F.when(peer, F.concat(F.lit("10.5555/"), F.col("doc_id").cast("string"))).alias("doi"),
            (1 + F.col("n_chars") / 1800).cast("int").alias("n_pages"),
            F.when(src < 10, "synthetic").otherwise("ingested").alias("provenance"),
        )

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")

    def scores(self) -> DataFrame:
        """doc_id, p_relevant, cluster_id: the stand-in scorer every checked query uses."""
        return self.raw("embeddings").select(
            F.col("vec_id").cast("string").alias("doc_id"),
            linear_score("embedding", SCORE_WEIGHTS).alias("p_relevant"),
            F.col("label").cast("bigint").alias("cluster_id"),
        )

    def clustered(self) -> DataFrame:
        """Vectors of relevant documents with their given cluster."""
        return (
            self.raw("embeddings")
            .select(
                F.col("vec_id").cast("string").alias("doc_id"),
                F.col("label").cast("bigint").alias("cluster_id"),
                "embedding",
                linear_score("embedding", SCORE_WEIGHTS).alias("p_relevant"),
            )
            .filter(F.col("p_relevant") >= 0.5)
            .drop("p_relevant")
        )

    def clusters(self) -> DataFrame:
        """doc_id, cluster_id of relevant documents, without vectors."""
        return self.scores().filter(F.col("p_relevant") >= 0.5).select("doc_id", "cluster_id")

    def cluster_labels(self) -> DataFrame:
        n = self.clusters().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_docs"))
        return n.select(
            "cluster_id", "n_docs",
            F.concat(F.lit("Topic cluster "), F.col("cluster_id").cast("string")).alias("label"),
            F.concat(F.lit("sector_"), (F.col("cluster_id") % 7).cast("string")).alias("sector"),
            _pick(F.col("cluster_id") % 3, ["impact", "adaptation", "mixed"]).alias("evidence_focus"),
            _pick(F.col("cluster_id") % 3, ["high", "medium", "low"]).alias("coherence_guess"),
        )

    def screening_labels(self) -> DataFrame:
        """Two annotators per labelled document."""
        split = split_of(F.col("doc_id").cast("string"))
        pairs = F.array(
            F.struct(F.lit("A1").alias("annotator"), F.col("quality").alias("label")),
            F.struct(F.lit("A2").alias("annotator"), (1 - F.col("toxic")).alias("label")),
        )
        return self.raw("labels").select(
            F.col("doc_id").cast("string").alias("doc_id"), F.inline(pairs), split.alias("split")
        )

    def metadata(self) -> DataFrame:
        """Model-extracted metadata, for every second document."""
        return self.raw("pages").select(
            (F.col("page_id") * 2).cast("string").alias("doc_id"),
            _pick(F.col("page_id") % 8, REGIONS).alias("region"),
            F.concat(F.lit("sector_"), (F.col("page_id") % 5).cast("string")).alias("sector"),
            F.when(F.length("url") % 2 == 0, "adaptation").otherwise("impact").alias("evidence_type"),
            (F.length("url") % 3 == 0).alias("outcome_reported"),
        )

    def decisions(self) -> DataFrame:
        e = self.raw("events")
        kind = (
            F.when(F.col("event_type") == "click", "screen_include").when(F.col("event_type") == "error", "screen_exclude")
            .when(F.col("event_type") == "view", "cluster_coherent").when(F.col("event_type") == "signup", "cluster_incoherent")
            .when(F.col("event_type") == "purchase", "citation_ok")
        )
        return e.select(
            F.col("event_id").cast("string").alias("decision_id"),
            F.col("user_id").cast("string").alias("doc_id"),
            F.when(F.col("event_type").isin("view", "signup"), F.col("user_id") % 10).alias("cluster_id"),
            kind.alias("decision_type"),
            F.concat(F.lit("rev"), (F.col("user_id") % 7).cast("string")).alias("reviewer"),
            F.col("props").alias("note"),
            F.col("ts").alias("decided_at"),
        )

    def submitted(self) -> DataFrame:
        """Decisions as they arrive at the service: some break a rule."""
        e = self.raw("events")
        return e.select(
            F.col("event_id").cast("string").alias("decision_id"),
            F.when(F.col("value") >= 2, F.col("user_id").cast("string")).alias("doc_id"),
            F.when(F.col("event_type").isin("view", "signup"), F.col("user_id") % 10).alias("cluster_id"),
            F.when(F.col("value") > 200, F.lit("shrug"))
            .when(F.col("event_type") == "click", "screen_include").when(F.col("event_type") == "error", "screen_exclude")
            .when(F.col("event_type") == "view", "cluster_coherent").when(F.col("event_type") == "signup", "cluster_incoherent")
            .otherwise("citation_ok").alias("decision_type"),
            F.when(F.col("value").between(10, 12), F.lit("")).otherwise(F.concat(F.lit("rev"), (F.col("user_id") % 7).cast("string"))).alias("reviewer"),
            F.when(F.col("value").between(150, 200), F.repeat(F.col("props"), F.lit(200))).otherwise(F.col("props")).alias("note"),
            F.col("ts").alias("decided_at"),
        )

    def annotations(self) -> DataFrame:
        """Labelling events; a row has labels in several tasks."""
        e = self.raw("events")
        model = F.col("event_id") % 3 == 0
        return e.select(
            F.col("event_id").cast("string").alias("label_id"),
            F.concat(F.lit("task_"), (F.floor(F.col("event_id") / 3) % 4).cast("string")).alias("task_id"),
            F.col("user_id").cast("string").alias("row_id"),
            F.col("event_type").alias("label"),
            F.when(model, "llm").otherwise("human").alias("source"),
            F.when(model, "model").otherwise(F.concat(F.lit("A"), (F.col("event_id") % 5).cast("string"))).alias("annotator"),
            F.when(model, F.round(F.least(F.lit(1.0), F.col("value") / 50), 4)).otherwise(F.lit(1.0)).alias("confidence"),
            F.col("props").alias("rationale"),
            F.col("ts").alias("labeled_at"),
        )

    def outcomes(self) -> DataFrame:
        li, o, c = self.raw("lineitem"), self.raw("orders"), self.raw("customer")
        n, r, p = self.raw("nation"), self.raw("region"), self.raw("part")
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(
                F.concat_ws("|", "r_name", "c_mktsegment").alias("context_similarity_key"),
                F.col("p_type").alias("adaptation_type"),
                F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative")
                .otherwise("mixed").alias("outcome_direction"),
                (F.col("l_discount") - F.col("l_tax")).alias("effect_size"),
            )
        )

    def runs(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("run_id"),
            F.concat(F.lit("ds_"), (F.col("o_custkey") % 50).cast("string")).alias("dataset_id"),
            F.col("o_orderpriority").alias("learning_type"),
            F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running")
            .otherwise("failed").alias("status"),
            (F.col("o_totalprice") * 1000000).cast("bigint").alias("bytes_billed"),
            (F.col("o_custkey") * 1000).alias("slot_ms"),
            F.col("o_orderdate").alias("started_at"),
            F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("created_by"),
            F.lit("").alias("sql_text"),
        )

    def models(self) -> DataFrame:
        """One model per succeeded run."""
        return self.raw("orders").filter(F.col("o_orderstatus") == "F").select(
            F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("model_id"),
            F.col("o_orderkey").cast("string").alias("run_id"),
            F.concat(F.lit("task_"), (F.col("o_custkey") % 20).cast("string")).alias("task"),
            F.col("o_orderpriority").alias("learning_type"),
            F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("artifact"),
            F.col("o_orderdate").alias("created_at"),
        )

    def evaluations(self) -> DataFrame:
        return self.raw("lineitem").select(
            _line_id().alias("eval_id"),
            F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("model_id"),
            F.when(F.col("l_returnflag") == "N", F.format_string('{"recall": 0.%02d}', (F.col("l_quantity") + 49).cast("int")))
            .otherwise(F.format_string('{"recall": 0.%02d, "roc_auc": 0.%02d}', (F.col("l_quantity") + 49).cast("int"),
                                       (F.lit(99) - F.col("l_quantity") / 2).cast("int"))).alias("metrics_json"),
            F.col("l_shipdate").alias("evaluated_at"),
        )

    def promotion_requests(self) -> DataFrame:
        step = F.col("l_linenumber") % 5
        return self.raw("lineitem").select(
            _line_id().alias("promotion_id"),
            F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("model_id"),
            _pick(step, ["archived", "candidate", "staging", "production", "retired"]).alias("to_stage"),
            F.when(F.col("l_tax") < 0.005, "  ").otherwise(F.concat(F.lit("flag "), F.col("l_returnflag"))).alias("reason"),
            F.concat(F.lit("actor_"), F.col("l_suppkey").cast("string")).alias("actor"),
            F.col("l_shipdate").alias("promoted_at"),
        )

    def datasets(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("ds_"), F.col("p_partkey").cast("string")).alias("dataset_id"),
            F.col("p_brand").alias("name"),
            F.col("p_size").cast("bigint").alias("version"),
            F.col("p_name").alias("notes"),
            (F.col("p_partkey") * 10).alias("n_rows"),
            F.col("p_partkey").alias("created_seq"),
        )

    def label_tasks(self) -> DataFrame:
        return self.raw("supplier").select(
            F.concat(F.lit("task_"), F.col("s_suppkey").cast("string")).alias("task_id"),
            F.concat(F.lit("ds_"), (F.col("s_suppkey") * 3 % 40).cast("string")).alias("dataset_id"),
            F.when(F.col("s_acctbal") < 0, "closed").otherwise("open").alias("status"),
            F.when(F.col("s_suppkey") % 2 == 0, '["click","view","error"]').otherwise('["signup","purchase"]').alias("label_space"),
            F.col("s_suppkey").alias("created_seq"),
        )

    def job_log(self) -> DataFrame:
        """One job per line item; the statement head varies so that every rule has matches."""
        heads = [
            "SELECT * FROM ML.GENERATE_TEXT(MODEL evidence.m, TABLE",
            "SELECT * FROM ML.GENERATE_EMBEDDING(MODEL evidence.m, TABLE",
            "CREATE OR REPLACE MODEL evidence.m AS SELECT",
            "CREATE MODEL evidence.m AS SELECT",
            "SELECT * FROM ML.FORECAST(MODEL evidence.m, TABLE",
            "SELECT * FROM VECTOR_SEARCH(TABLE evidence.chunks, TABLE",
            "SELECT",
            "SELECT 1 FROM evidence.corpus WHERE",
        ]
        li, p = self.raw("lineitem"), self.raw("part")
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.col("l_shipdate").alias("creation_time"),
            F.concat_ws(" ", _pick(F.col("l_linenumber") % 8, heads), F.col("p_name")).alias("query"),
            (F.col("l_extendedprice") * 1000000).cast("bigint").alias("total_bytes_billed"),
            (F.col("l_quantity") * 1000).cast("bigint").alias("total_slot_ms"),
        )

    def replies(self) -> DataFrame:
        """Model replies around the JSON property of each event: fenced, bare or cut short."""
        body = F.concat(
            F.lit('{"label":"'), F.col("event_type"), F.lit('","decision":"'),
            F.when(F.col("event_type") == "click", "include").when(F.col("event_type") == "error", "exclude").otherwise("needs_full_text"),
            F.lit('","criterion":"'), (F.col("user_id") % 3 + 1).cast("string"),
            F.lit('","agrees_with_model":'), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"),
            F.lit(',"confidence":'), F.format_string("0.%02d", (F.col("event_id") % 100).cast("int")),
            F.lit(',"reason":null,"extra":'), F.col("props"),
            F.lit(',"records":[{"action":"'), F.col("event_type"), F.lit('","effect_size":'),
            F.when(F.col("user_id") % 5 == 0, "null").otherwise(F.format_string("0.%02d", (F.col("user_id") % 100).cast("int"))),
            F.lit('},{"action":"second","effect_size":"n/a"}]}'),
        )
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("row_id"),
            F.col("user_id").cast("string").alias("doc_id"),
            F.col("event_type"),
            F.when(F.col("event_id") % 7 == 0, F.substring_index(body, ',"records"', 1))
            .when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .otherwise(body).alias("raw"),
        )

    def cited_texts(self) -> DataFrame:
        """Drafted paragraphs: every turn of a conversation, ending in two citations."""
        c = self.raw("conversations")
        known = (F.col("conv_id") * 3 + F.col("turn")).cast("string")
        other = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("missing-"), F.col("turn").cast("string"))).otherwise(F.col("conv_id").cast("string"))
        return c.select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"),
            F.concat(F.col("text"), F.lit(" ["), known, F.lit(" p."), (F.col("turn") + 1).cast("string"), F.lit("] and ["), other,
                     F.lit(" p.2].")).alias("body"),
        )
