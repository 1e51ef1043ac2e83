"""harrow: page-safety, content-cleaning and agent-run analytics on PySpark."""
