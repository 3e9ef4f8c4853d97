"""Operators for training-data corpora and record collections. Nothing else in the package imports this one."""
