"""Queries over the driver's tables, module by module."""
