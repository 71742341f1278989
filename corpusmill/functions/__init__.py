"""Column -> Column building blocks and the fixed word lists they use."""
