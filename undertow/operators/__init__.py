"""Graph operators: each takes graphs or frames and returns new ones, lazily unless it iterates."""
