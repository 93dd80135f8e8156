"""Operators for preparing training data.  Nothing else in wattline imports this."""
