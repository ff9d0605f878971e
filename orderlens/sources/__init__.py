"""Reading and writing order-line data."""
