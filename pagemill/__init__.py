"""Paginated catalog harvesting on Spark.

Landed listing pages become rows, rows become per-page chunks, chunks become a
consolidated catalog, and the catalog is reconciled with crawl metadata.  Every
step is a function from DataFrame to DataFrame.
"""

__version__ = "0.1.0"
