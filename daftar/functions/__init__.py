"""Column-returning functions: text, calendar, geometry, arrays."""
