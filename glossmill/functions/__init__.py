"""glossmill functions."""
