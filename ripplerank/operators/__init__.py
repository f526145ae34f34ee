"""Graph, label, split, metric and statistics operators."""
