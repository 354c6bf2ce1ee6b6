"""All registered queries of the core, by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

from quorumdf.plans import q_metrics, q_models, q_tables, q_text, q_votes

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_tables, q_votes, q_metrics, q_text, q_models):
    for _name, (_query, _sql) in _module.REGISTER.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLES[_name] = _sql

FLAGSHIP = "q_choice_combiner"
