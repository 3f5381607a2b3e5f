"""Sources and sinks: parquet tables, stand-in fixture views, polygon layers."""
