"""Column-to-column functions: nothing here reads or shuffles data."""
