"""Lake and model readers and writers."""
