"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`lexiforge.llm.queries` derives the registered
``opN_*`` queries from them.
"""
