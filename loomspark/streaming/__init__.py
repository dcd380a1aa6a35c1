"""Structured Streaming extension: windows with watermarks, sessions, and appends to the object log."""
