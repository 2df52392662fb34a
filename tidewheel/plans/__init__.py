"""Query plans and their SQL twins."""
