"""streaming of notewright."""
