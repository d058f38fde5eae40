"""Document-block analytics on Spark: layout, masking, scoring, ranking, auditing and roll-ups of translated documents."""
