"""All query modules of the subpackage."""

from nichelens.llm import corpus_queries, history_queries, language_queries, page_queries, record_queries

MODULES = [record_queries, history_queries, language_queries, corpus_queries, page_queries]
