"""Column-level functions: labels, suppression rule, geometry math, casts."""
