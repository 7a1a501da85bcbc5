"""Spatio-temporal population and origin-destination flow analytics on Spark."""
