"""Event streams: windows and keyed state, with the same functions for batches."""
