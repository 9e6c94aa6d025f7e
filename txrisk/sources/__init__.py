"""Sources and sinks: fixture table, CSV / Parquet readers and writers."""
