"""Training-data operators: a self-contained subpackage that nothing else in the library imports.

Each module holds one operator with its own general interface; ``queries`` wraps each one for the
command table.  See the module docstrings for null, empty, tie and repeated-row behaviour.
"""
