"""Early-warning analytics on weekly entity x category panels, written for Spark."""
