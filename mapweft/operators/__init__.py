"""Table operators: joins, aggregates, windows, graphs, tiles."""
