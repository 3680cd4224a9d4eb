"""parity: Spark jobs that check, load, normalise and score equivalent queries."""
