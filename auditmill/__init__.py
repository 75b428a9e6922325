"""Multi-tenant audit logging and analysis on Spark."""
