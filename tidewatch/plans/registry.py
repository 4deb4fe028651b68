"""Named queries of the event engine with their SQL equivalents."""

from __future__ import annotations

FLAGSHIP = "incident_fold"


def _modules():
    from tidewatch.plans import event_queries, feed_queries, incident_queries, place_queries, relation_queries, report_queries, stream_queries

    return event_queries, feed_queries, incident_queries, relation_queries, place_queries, report_queries, stream_queries


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out.update(module.ORACLE)
    return out
