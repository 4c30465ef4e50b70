"""Service-request and incident analytics as plain DataFrame functions on Spark."""
