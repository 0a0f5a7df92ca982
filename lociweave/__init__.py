"""Order-aware conserved-sequence analytics on Spark."""
