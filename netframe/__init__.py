"""netframe: graph analytics on Spark DataFrames.

Graphs are vertex and edge tables, matrices are long tables (i, j, v), algorithms are joins and
grouped aggregations inside small driver-side loops.
"""

from netframe.operators.graph import PropertyGraph
from netframe.plans.session import engine_info, session

__all__ = ["PropertyGraph", "engine_info", "session"]
