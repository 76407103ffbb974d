"""Column kinds and scalar expressions."""
