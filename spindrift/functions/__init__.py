"""Column functions: text, dates, classification, links, hashing and redaction."""
