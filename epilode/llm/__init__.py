"""Operators for preparing training text: packing, chat format, duplicates, filters, search."""
