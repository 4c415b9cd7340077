"""Knowledge-archive analytics on Spark."""
