"""Training-data operators: ten first-class components for corpus preparation.

Nothing outside this subpackage imports it; its queries live in ``queries.py``.
"""
