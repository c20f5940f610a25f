"""Document operators: HTML extraction, feed parsing, fetch normalization."""
