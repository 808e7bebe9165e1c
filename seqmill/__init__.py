"""Analytics over ordered event logs, token sequences and tables, written for Spark."""
