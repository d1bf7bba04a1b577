"""All queries outside the llm package, by name."""

from __future__ import annotations

from tallgrass.plans import corpus, distributions, evaluation, formats, gates, grading, packed, prompts, qualified, relational, round_trips, samples, streams

MODULES = (corpus, distributions, evaluation, formats, gates, grading, packed, prompts, qualified, relational, round_trips, samples, streams)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "corpus_reject_reasons"
