"""Column functions: text analysis and stemming."""
