"""weftline: a PySpark library for preparing, auditing and listing large collections of documents and records."""
