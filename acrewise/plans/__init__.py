"""Named report queries, one function per report id of the original analyses."""
