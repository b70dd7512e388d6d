"""Operators for preparing training text: filters, de-duplication, mixing, sharding and scoring."""
