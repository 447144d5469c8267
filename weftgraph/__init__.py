"""weftgraph: community detection on weighted graphs, planned by Catalyst.

Graphs are DataFrames of half-edges ``(src, dst, w)``; every step of the
multi-level Louvain method is a relational query over them.
"""
