"""functions of notewright."""
