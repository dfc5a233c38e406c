"""glossmill plans."""
