"""Alarm-episode analytics as Spark DataFrame transformations."""
