"""Column functions: identifiers, normal forms, patterns, expiry."""
