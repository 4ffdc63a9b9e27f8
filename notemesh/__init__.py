"""notemesh: note-corpus retrieval and knowledge-graph analytics on PySpark."""

__version__ = "0.1.0"
