"""estatelens: listing analytics and text preparation as Spark DataFrame jobs.

Layout:
  sources/    readers for the listings table and the text tables, schema checks
  functions/  Column -> Column expressions (formatting, geography, HTML, chunking)
  operators/  DataFrame -> DataFrame operators (filters, windows, top-k, stats, reports)
  plans/      end-to-end reports and the registry of named queries + oracle SQL
  streaming/  the stateless text jobs run over a file stream
  sinks.py    writers (report text, report table, message outbox)
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run them
    without the package being installed on executors."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
        pass


_ship_by_value()
