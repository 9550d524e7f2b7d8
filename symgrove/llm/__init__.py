"""Operators that prepare code and text for training language models; optional part of the library."""
