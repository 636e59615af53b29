"""Reading comment tables and writing result tables."""
