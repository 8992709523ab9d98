"""Column functions: text of layouts, names, answers, replies of models, modalities."""
