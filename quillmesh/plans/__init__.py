"""Plans out of operators: the chains from layouts to verdicts, and the query catalogue."""
