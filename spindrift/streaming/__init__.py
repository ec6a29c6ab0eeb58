"""Incremental resolution and stateful gates, as streams and as replays of a table."""
