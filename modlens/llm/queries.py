"""The operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from modlens.llm import audit, ctw, decontamination, dedup_spans, fingerprints, language, mixing, neardup, pages, quality, toxicity, tries, vectors


def queries():
    found = [
        toxicity.op1_toxicity,
        quality.op2_quality,
        dedup_spans.op3_repeated_spans,
        pages.op4_main_text,
        vectors.op5_near_vectors,
        ctw.op6_context_tree,
        language.op7_language,
        neardup.op8_near_duplicates,
        decontamination.op9_benchmark_passages,
        mixing.op10_mix_sources,
        audit.op11_filter_audit,
        tries.op12_conversation_trie,
        fingerprints.op13_document_fingerprints,
    ]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op10_mix_sources": mixing.SQL, "op11_filter_audit": audit.SQL, "op12_conversation_trie": tries.SQL}
