"""Column-level functions: indicators, targets, calendar rules and text scoring."""
