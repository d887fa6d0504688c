"""Word lists and rule tables, as data."""
