"""glossmill operators."""
