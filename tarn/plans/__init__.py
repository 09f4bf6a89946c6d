"""Query plans by name, with the SQL that states the same result."""
