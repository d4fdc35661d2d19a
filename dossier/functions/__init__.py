"""Column functions for text, money, dates and records."""
