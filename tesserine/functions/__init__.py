"""Column functions over scalars, dates, strings, arrays and maps."""
