"""Named queries, their SQL twins, and session helpers."""
