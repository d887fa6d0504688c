"""End-to-end pipelines of operators."""
