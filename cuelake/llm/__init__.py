"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``entries`` holds the registered queries built on them.
"""
