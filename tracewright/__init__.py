"""Query catalogue, record provenance and data debugging on the public PySpark API."""
