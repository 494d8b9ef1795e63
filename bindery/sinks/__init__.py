"""Where frames, tables and extracted files are written."""
