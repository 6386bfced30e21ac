"""Generated documents for tests and trials."""
