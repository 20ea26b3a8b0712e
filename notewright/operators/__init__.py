"""operators of notewright."""
