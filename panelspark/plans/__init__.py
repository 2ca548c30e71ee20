"""End-to-end plans: the stored pipeline and the registered sample queries."""
