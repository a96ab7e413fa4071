"""Firmware signature analytics on Spark."""
