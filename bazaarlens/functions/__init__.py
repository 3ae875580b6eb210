"""Column functions: calendar arithmetic, flags and ratios, distribution tails."""
