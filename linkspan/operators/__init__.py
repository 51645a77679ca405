"""Operators over telemetry tables."""
