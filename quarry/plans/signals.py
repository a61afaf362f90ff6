"""Signal and score queries on facts made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import compilers, signals

from .catalogue import query

_EVENTS = ["4648", "5140", "4732", "1102", "4624", "5145", "104"]
_TEXTS = ["share \\\\host\\C$ was read", "member of S-1-5-32-544", "member of S-1-5-32-545", "Audit log cleared", "wevtutil cl Security"]
_EVENT_LIST, _TEXT_LIST = (", ".join(f"'{x}'" for x in values) for values in (_EVENTS, _TEXTS))
_FACTS = f"(SELECT event_id, [{_EVENT_LIST}][event_id % 7 + 1] AS code, lower([{_TEXT_LIST}][event_id % 5 + 1]) AS message FROM events)"


def _records(t):
    """Event-log records with a code and a message by the event's number."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    body = F.to_json(F.struct(pick(_EVENTS, 7).alias("EventID"), pick(_TEXTS, 5).alias("Message")))
    return t("events").select(F.lit("parse_event_logs").alias("tool"), F.col("event_id").alias("record_no"), body.alias("record"))


_FIRED = f"""SELECT unnest(list_filter([CASE WHEN code IN ('5140', '5145') AND message LIKE '%c$%' THEN 'admin_share_access' END, CASE WHEN code = '4648' THEN 'explicit_credential_logon' END,
    CASE WHEN code = '4732' AND message LIKE '%-544%' THEN 'privileged_group_modification' END,
    CASE WHEN code = '1102' OR (code = '104' AND message LIKE '%cleared%') OR message LIKE '%wevtutil cl%' THEN 'anti_forensics_execution' END], lambda x: x IS NOT NULL)) AS signal FROM {_FACTS}"""


@query(f"SELECT signal, count(*) AS n FROM ({_FIRED}) GROUP BY 1")
def semantic_signals(t):
    facts = compilers.compile_records(_records(t)).where("drop_reason IS NULL")
    return signals.with_signals(facts).select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
