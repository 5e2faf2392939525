"""quillon: a time-series analytics engine on the PySpark DataFrame API."""
