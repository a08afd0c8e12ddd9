"""Operators of a training-data pipeline: search, formatting, labelling, storage, copies, packing."""
