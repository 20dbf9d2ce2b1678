"""State kept for each recording while its windows arrive."""
