"""Column functions: splice sections, text formats, identifiers."""
