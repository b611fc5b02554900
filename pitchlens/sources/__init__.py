"""Sources and sinks: files, tables, JSON payloads, exchange listings."""
