"""Column expressions: text, dates, links, votes and JSON."""
