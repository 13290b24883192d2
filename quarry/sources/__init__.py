"""Sources and sinks: table readers, word lists, persisted index tables."""
