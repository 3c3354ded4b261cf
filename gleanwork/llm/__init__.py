"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this package; the driver contract adds its queries only
if it is there. Every operator takes and returns DataFrames and leaves columns it was not
told about alone.
"""
