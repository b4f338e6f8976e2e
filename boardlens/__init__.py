"""Analytics for embedded-board operations data, and corpus operators, on PySpark."""
