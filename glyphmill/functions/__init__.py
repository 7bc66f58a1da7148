"""functions of glyphmill."""
