"""Operators for preparing language-model training text at corpus scale.

Every operator takes and returns DataFrames and keeps its own general
interface; ``queries`` binds them to the registered ``opN_*`` queries.
Nothing outside this subpackage imports it.
"""
