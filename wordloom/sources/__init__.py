"""Reading and writing corpora and indexes."""
