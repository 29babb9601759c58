"""Training-data operators: each module holds one operator with a general interface.

Nothing outside this subpackage imports it; ``queries`` holds the thin
``opN_*`` queries that the entry module registers when the subpackage exists.
"""
