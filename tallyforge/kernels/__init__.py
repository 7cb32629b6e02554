"""Plain numpy and Python: hashes, confidence intervals, quantile and sampling summaries."""
