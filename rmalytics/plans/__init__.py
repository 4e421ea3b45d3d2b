"""Registered report plans over the driver's tables, with their SQL oracles."""
