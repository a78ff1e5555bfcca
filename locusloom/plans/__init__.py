"""Physical strategies: binned joins and running aggregates in two levels."""
