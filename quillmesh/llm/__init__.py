"""Operations of a training-data pipeline: packing, near-duplicates, scoring, language, hosts, tokens, lines, search."""
