"""DataFrame -> DataFrame operators, grouped by theme."""
