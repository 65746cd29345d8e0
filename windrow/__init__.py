"""Conversation-context analytics on Spark."""
