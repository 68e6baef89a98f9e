"""Lodestone: structural code and change-history analytics on PySpark."""
