"""sources of notewright."""
