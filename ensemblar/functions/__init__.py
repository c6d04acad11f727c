"""Column functions: dates, weights, index phases, keyed randomness and ensemble scores."""
