"""Landing, layered tables and the variable registry."""
