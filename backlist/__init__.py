"""backlist: catalog-sales analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected to the driver except metadata (column names, partition counts)
and one-row scalars that the plan itself needs as literals.
"""

from backlist.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
