"""DataFrame -> DataFrame operators; none collects rows."""
