"""Sources and sinks: parquet / JSON tables, keyed JSON messages, domain views."""
