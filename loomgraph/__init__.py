"""loomgraph: community detection and connectivity analysis on edge lists, as Spark jobs."""

__version__ = "0.1.0"
