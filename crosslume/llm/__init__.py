"""Operators for preparing training data: filters, duplicates, packing, formats and classifiers."""
