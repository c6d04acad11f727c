"""DataFrame operators of forecast verification."""
