"""razao: ledger analytics on Spark DataFrames.

Subpackages: ``functions`` (Column builders), ``sources`` (readers),
``operators`` (DataFrame -> DataFrame transformations), ``plans`` (derived
views over the driver tables and the registered queries), ``sinks``
(writers) and ``streaming`` (incremental file processing).
"""

__version__ = "0.1.0"
