"""Helpers that shape execution: lineage cuts, size-checked broadcasts, tables."""
