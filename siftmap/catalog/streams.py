"""Streaming queries: the stream runs to its end, then its output is read back."""

from __future__ import annotations

from siftmap.catalog import query
from siftmap.session import new_path
from siftmap.sources.domain import DECISION_TYPES, Domain
from siftmap.streaming import decisions as st
from siftmap.streaming import keyed


class _Streamed(Domain):
    """The same derivations over a stream of the events table."""

    def raw(self, name):
        # a glob, as the file source takes a plain path for a folder and the table may be one file
        return st.read_events(self.spark, f"{self.base}/{name}.parque[t]") if name == "events" else super().raw(name)


def streamed(d):
    return _Streamed(d.spark, d.base)


VALID = f"""SELECT decision_id, doc_id, cluster_id, decision_type, reviewer FROM submitted WHERE (doc_id IS NOT NULL OR cluster_id IS NOT NULL)
 AND decision_type IN ({", ".join(f"'{t}'" for t in DECISION_TYPES)}) AND length(reviewer) BETWEEN 1 AND 120 AND (note IS NULL OR length(note) <= 1000)"""


@query("stream_decision_ingest", VALID)
def _(d):
    out = new_path(d.spark, "decisions")
    s = streamed(d).submitted()
    keyed.ingest(s, DECISION_TYPES, out, new_path(d.spark, "checkpoint"))
    return d.spark.read.schema(s.schema).parquet(out).drop("note", "decided_at", "batch")


@query("stream_latest_decision", """SELECT doc_id, decision_type AS human_decision FROM decisions WHERE decision_type LIKE 'screen_%'
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY decided_at DESC, decision_id DESC) = 1""")
def _(d):
    out = new_path(d.spark, "latest")
    keyed.latest(streamed(d).decisions(), out, new_path(d.spark, "checkpoint"))
    return keyed.current(d.spark, out)


@query("stream_monitoring_daily", """SELECT d.decided_at::DATE AS day, d.decision_type, count(*) AS n,
  count_if((d.decision_type = 'screen_include' AND s.p_relevant < 0.5) OR (d.decision_type = 'screen_exclude' AND s.p_relevant >= 0.5))::BIGINT AS n_override
 FROM decisions d LEFT JOIN scores s ON s.doc_id = d.doc_id GROUP BY ALL""")
def _(d):
    out = new_path(d.spark, "daily")
    keyed.daily(streamed(d).decisions(), out, new_path(d.spark, "checkpoint"))
    return st.daily_report(keyed.daily_totals(d.spark, out), d.scores())
