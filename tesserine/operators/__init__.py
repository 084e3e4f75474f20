"""Table operators and nested-collection operators."""
