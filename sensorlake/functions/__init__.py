"""Column functions: geometry, geodesy, projection, formatting."""
