"""Record operators: search, dedup, lifecycle, governance, graph, mining."""
