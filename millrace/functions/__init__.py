"""Column-level building blocks: declared types, sentinels, comparisons."""
