"""Table and text sources, sinks as table-to-table jobs."""
