"""Translation of data that keeps arriving."""
