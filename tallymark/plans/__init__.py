"""The full jobs: growth indicator, release table, checks."""
