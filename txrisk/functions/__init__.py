"""Column -> Column helpers (built-in expressions only)."""
