"""Training-data operators: dedup, mixing, scoring, filtering and tokenising of text corpora.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame and column names and returns a
DataFrame; the thin ``opN_*`` queries live in :mod:`mirrorloom.llm.queries`.
"""
