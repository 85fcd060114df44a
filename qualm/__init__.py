"""qualm: judge uncertainty scores against answer quality, as Spark jobs.

Every public operator takes and returns DataFrames. Work is expressed with the
DataFrame / SQL API so Catalyst and AQE plan it; Arrow-batched kernels appear
only where a column expression cannot do the work (top-k distances, LCS,
kernel density, local spanning trees).
"""

__all__ = ["session"]
