"""DataFrame -> DataFrame operators; keys are parameters."""
