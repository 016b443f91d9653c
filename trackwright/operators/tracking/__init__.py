"""Trackers: pure step functions over frames, and the adapters that run them in batch and in streams."""
