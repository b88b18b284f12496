"""regiolens: Spark-native analytics for regional enrollment counts.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API so Catalyst and AQE plan the physical work.  The
sub-packages follow the data flow:

``sources``    readers, the TPC-H adapter, derived columns, sinks
``functions``  shared column expressions (null/ANSI-safe helpers, rules)
``operators``  quality, descriptive, anomaly, forecasting, policy, report
``plans``      shared marts and the end-to-end pipeline
``streaming``  incremental ingestion of arriving CSV files
"""

from regiolens.params import Params
from regiolens.schema import FactSchema, DEFAULT_SCHEMA

__all__ = ["Params", "FactSchema", "DEFAULT_SCHEMA"]
