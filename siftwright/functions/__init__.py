"""Column functions: text, keys, arrays, probability vectors and schedules."""
