"""operators of glyphmill."""
