"""Readers for the given tables and for captured telemetry inputs."""
