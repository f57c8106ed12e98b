"""The per-epoch features and labels on a live stream."""
