"""Native Column expressions."""
