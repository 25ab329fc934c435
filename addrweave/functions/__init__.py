"""Column functions: cleaning, tokens, similarity, scores."""
