"""Plan-level helpers: staging, sizing, keyed merges."""
