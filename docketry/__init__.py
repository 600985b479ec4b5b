"""docketry: a Spark-first engine for dated, split-tagged legal record graphs.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame), ``sources`` (scans and
sinks), ``streaming`` (incremental forms), ``plans`` (registered queries) and, where it is installed, ``llm``
(text operators for training corpora; nothing else here imports it).
"""

__version__ = "0.1.0"

try:  # functions go to executors by value, so that these need not have the package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # the package can be looked at without Spark
    pass
