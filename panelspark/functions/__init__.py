"""Column functions: calendar, hashing and scoring expressions."""
