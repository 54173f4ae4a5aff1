"""Plan helpers: lineage cuts, scalar lookups and report ordering."""
