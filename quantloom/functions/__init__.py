"""Column functions: by stock over time, by date over stocks, and by cell."""
