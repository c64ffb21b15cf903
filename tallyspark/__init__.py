"""Statement parsing, card rewards and training-data operators as Spark jobs."""
