"""plans of notewright."""
