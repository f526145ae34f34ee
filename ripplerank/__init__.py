"""Network-ranking analytics on Spark: clean graphs, propagate seeds, score rankings, judge them."""
