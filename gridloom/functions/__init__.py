"""Column expressions: ratios, stable probability forms, special functions, classification and text helpers."""
