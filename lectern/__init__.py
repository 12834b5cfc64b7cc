"""lectern: document indexing, hybrid retrieval and corpus preparation on PySpark."""
