"""glossmill sources."""
