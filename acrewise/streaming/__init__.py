"""Streaming.

The analyses this package rebuilds have no streams, watermarks, windows
over time or custom state (the source holds only batch SQL and R scripts),
so no streaming operator is defined here. Every operator is a DataFrame
function and runs unchanged on a streaming DataFrame where Spark allows the
operation (projections, filters, stream-static joins such as tagging new
workplace points against a static polygon layer).
"""
