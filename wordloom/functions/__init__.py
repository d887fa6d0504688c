"""Column functions: normalisation, similarity, tokens, grades."""
