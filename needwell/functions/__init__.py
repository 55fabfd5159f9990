"""Column functions: every helper takes and returns ``Column`` objects."""
