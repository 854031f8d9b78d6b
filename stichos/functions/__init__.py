"""Column builders: no joins, no shuffles."""
