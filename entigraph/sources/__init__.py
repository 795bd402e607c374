"""Sources and sinks: catalog tables, snapshots, text and JSON renderings."""
