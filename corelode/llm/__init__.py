"""Training-data operators over text and vector tables.

Each module holds one operator with a general interface; :mod:`corelode.llm.queries`
derives the registered queries from them.  Nothing outside this subpackage imports it.
"""
