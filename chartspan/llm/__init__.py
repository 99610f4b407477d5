"""Training-data operators for text corpora, each a function from DataFrames to a DataFrame.

Nothing else in the library imports this subpackage.
"""
