"""DataFrame operators: masking, layout, look-ups, ranking, roll-ups."""
