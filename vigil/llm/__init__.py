"""Training-data operators: ten distributed text/vector operators and their registered queries.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the thin registered queries and
``oracles`` their DuckDB SQL.
"""
