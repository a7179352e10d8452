"""Conversations, recorded and live, as Spark tables and streams."""
