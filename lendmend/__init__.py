"""Consumer-lending data repair and credit decisions as Spark jobs.

Sub-packages
------------
functions   Column -> Column building blocks (ratios, bands, vectors, scorecard)
sources     landing, zones, relational sync, message stream
operators   DataFrame -> DataFrame steps and MLlib estimators
plans       reports, dashboards and the end-to-end batch flow
streaming   micro-batch decision flow and its monitoring
"""

__version__ = "0.1.0"
