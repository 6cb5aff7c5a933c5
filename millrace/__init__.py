"""millrace: change-stream analytics and corpus processing on PySpark."""
