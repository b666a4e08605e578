"""Operators for building language-model training corpora.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; :mod:`talusgrid.llm.registry` derives the
registered ``opN_`` queries from them.
"""
