"""Column functions: they build expressions and never run anything."""
