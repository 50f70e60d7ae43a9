"""A catalogue and text engine on PySpark."""
