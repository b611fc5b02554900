"""End-to-end compositions of operators (preprocessing, scoring, search)."""
