"""glossmill streaming."""
