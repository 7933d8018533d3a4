"""Stage reading and frozen scoring on streams of newly arriving files."""
