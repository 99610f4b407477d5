"""Analytics over longitudinal event tables, text and concept hierarchies as Spark DataFrame plans."""
