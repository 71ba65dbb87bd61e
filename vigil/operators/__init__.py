"""Relational and statistical operators over the telemetry fact table."""
