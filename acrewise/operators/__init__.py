"""DataFrame -> DataFrame operators: spatial joins, overlay, reshape, survey."""
