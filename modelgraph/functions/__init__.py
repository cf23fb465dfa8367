"""Column functions: parsing, rendering, coercion."""
