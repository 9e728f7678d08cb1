"""Structured Streaming jobs over frame-by-frame detection logs."""
