"""Transition-log analytics for distributed at-least-once work queues, on Spark."""
