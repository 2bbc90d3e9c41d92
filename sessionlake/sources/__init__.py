"""Containers, the Spark data source that reads them, and the session lake."""
