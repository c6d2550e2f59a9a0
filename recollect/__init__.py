"""Analytics over agent memory, task ledgers and audit trails, written with PySpark's DataFrame and SQL interfaces."""
