"""Column functions: text, identifiers, paths, tokens, redaction."""
