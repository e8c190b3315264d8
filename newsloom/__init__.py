"""News and social-coverage analytics on PySpark."""
