"""Training-data operators: extraction, deduplication, scoring, tokenizers, archives.

The rest of the library never imports this subpackage; its queries are
registered by :mod:`weftgraph.llm.queries`.
"""
