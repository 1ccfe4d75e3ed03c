"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; the thin queries over the standard tables are in
:mod:`shardloom.llm.queries`.
"""
