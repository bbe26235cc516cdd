"""Column functions: text, time, address and log-message helpers."""
