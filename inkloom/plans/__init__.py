"""Whole runs: linting a corpus, reports, comparisons of corpora."""
