"""Value-level column expressions; every function takes and returns Columns."""
