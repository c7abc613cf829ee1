"""A Spark-native engine for retrieval-augmented generation pipelines."""

from __future__ import annotations

from importlib import import_module

_PUBLIC = {
    "ragloom.plans.pipeline": ("Transformer", "queries", "ranked", "cutoff", "first_topics", "shared_runs"),
    "ragloom.operators.retrieval": ("bm25", "dense", "rescored", "with_texts", "hashed_vectors", "bare_queries", "only_for", "distinct_documents"),
    "ragloom.operators.index": ("TermIndex",),
    "ragloom.operators.vector_index": ("VectorIndex",),
    "ragloom.operators.context": ("concatenator", "concat", "concat_items", "format_item", "frame_concat"),
    "ragloom.operators.generation": (
        "Backend", "EchoBackend", "ExtractiveBackend", "FunctionBackend", "HTTPBackend", "LocalModelBackend", "ScriptedBackend", "get_backend", "set_default_backend", "default_backend", "generated", "prompts", "reader",
        "reasoning_extractor", "fusion_inputs", "fusion_reader", "ranked_tokens",
    ),
    "ragloom.operators.agents": ("AgenticRAG", "IRCOT", "SearchO1Loop", "search_r1", "search_o1", "r1_searcher", "limited_r1_searcher", "forced_search", "standalone"),
    "ragloom.operators.aicl": ("AICLContextSelector", "answer_rate"),
    "ragloom.operators.kg": ("exemplars", "extract_graph", "reasoning_chains", "chain_texts", "chain_documents"),
    "ragloom.operators.evaluation": ("MEASURES", "by_query", "bertscore", "judged_pointwise", "judged_pairwise", "experiment", "compared", "long_form", "against_baseline", "result_stats", "exploded_gold"),
    "ragloom.sources.datasets": ("get_dataset", "list_datasets", "register_dataset", "known_datasets", "members", "members_listed", "unpacked", "located", "malformed_lines"),
    "ragloom.sources.archives": ("archive_lines", "archive_texts"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    """Public names, imported when they are first used."""
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
