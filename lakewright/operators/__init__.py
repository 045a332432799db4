"""DataFrame operators: unify, dedup, selection, corpus, search, scoring."""
