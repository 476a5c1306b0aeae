"""Training-data operators: each module holds one operator with its own general interface.

``queries.py`` derives the registered ``opN_*`` queries from them, ``oracles.py`` their SQL.
Nothing outside this subpackage imports it.
"""
