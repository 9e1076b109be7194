"""Column builders: vector math, text, scores."""
