"""The frame pipe as a structured stream."""
