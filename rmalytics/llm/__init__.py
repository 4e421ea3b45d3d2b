"""Operators for building training data at scale, one module per operator.

Nothing outside this package imports it; the registered queries are in
``registry`` and the document pipeline is ``corpus_pipeline`` at the top.
"""
