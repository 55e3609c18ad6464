"""Operators for preparing training text, one module for each operator.

Nothing outside this folder imports it.  ``queries`` registers one query for
every operator; ``corpus_pipeline.py`` at the top of the repository chains five
of them.
"""
