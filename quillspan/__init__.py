"""quillspan: Spark-native analytics over landed feed records and entity snapshots."""

__version__ = "0.1.0"
