"""Frame sources and hash sinks."""
