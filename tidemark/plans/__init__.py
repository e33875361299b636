"""Ready-made jobs, and the queries over the driver tables."""
