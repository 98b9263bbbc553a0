"""Panel bars and running averages over streams of events."""
