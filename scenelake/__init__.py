"""scenelake: satellite-imagery tables as DataFrames.

Pixels, scene catalogs, areas of interest, regions and text logs are plain Spark
tables; every operator is a function from DataFrame to DataFrame or from Column to
Column, so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
