"""cadastra: land-parcel analytics on Spark DataFrames.

Layers: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers, writers, caches), ``plans`` (composed
searches and jobs) and ``streaming``.
"""
