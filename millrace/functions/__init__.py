"""Column functions: positions, ids, safe values, delivery statuses."""
