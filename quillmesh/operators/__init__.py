"""DataFrame to DataFrame operators: linking, composing, verdicts, synthesis, retrieval, evaluation, judges."""
