"""sluice: metadata-driven ingestion and data quality as Spark DataFrame jobs.

Control tables say what to load and how; the operators in this package turn
that metadata into lazy DataFrame plans (hash, classify, merge, watermark,
drift, data-quality rules, audit).  Only ``sluice.sinks`` and ``sluice.plans``
run actions.
"""

__version__ = "0.1.0"
