"""operators of tallyloom."""
