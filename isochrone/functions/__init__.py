"""Column-level building blocks: numeric guards, calendar arithmetic, frequency constants."""
