"""Decoding of frames: link to transport as columns, applications from payloads."""
