"""Reading and writing tables: catalog, scans, verified sinks, stage tables."""
