"""Token-launch market and funding-graph analytics as Spark jobs."""
