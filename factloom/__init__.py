"""factloom: a PySpark-native knowledge-fact engine.

Claims with evidence are resolved, validated, merged and stored on two time
lines, and served as fact queries, tables, graphs, triples and claim checks.
Everything is declared with DataFrames so that Catalyst plans the work.
"""

__version__ = "0.1.0"
