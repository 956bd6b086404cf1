"""Where frames are kept, written and read."""
