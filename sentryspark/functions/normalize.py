"""Event type names of several tracing frameworks mapped to one vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical type -> the framework names that mean it.
EVENT_TYPE_ALIASES = {
    "llm_call": ["llm.call", "gen_ai.chat", "llm.completion", "on_llm_start", "on_llm_end"],
    "tool_invocation": ["tool.invoke", "tool.call", "tool.execute", "on_tool_start", "on_tool_end"],
    "rag_retrieval": ["retrieval", "rag.query", "rag.retrieval", "on_retriever_start",
                      "on_retriever_end"],
    "agent_decision": ["on_chain_start", "on_chain_end"],
}


def normalize_event_type(column: Column) -> Column:
    """Canonical event type; unknown names pass through in lower case."""
    lowered = F.lower(column)
    canonical = lowered
    for name, aliases in EVENT_TYPE_ALIASES.items():
        canonical = F.when(lowered.isin(aliases), F.lit(name)).otherwise(canonical)
    return canonical
