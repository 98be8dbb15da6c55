"""Analytics over token-call logs, prompts, tool catalogues, vectors and corpora, on Spark."""
