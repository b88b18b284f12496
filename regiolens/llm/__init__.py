"""Training-data operators for very large text corpora.

One module per operator; ``queries`` registers a thin query for each, and
``corpus_pipeline.py`` at the repository top chains five of them.  Nothing
outside this subpackage imports it.
"""
