"""Readers with explicit schemas and null rules, and sinks."""
