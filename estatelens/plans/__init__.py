"""End-to-end reports and the registry of named queries."""
