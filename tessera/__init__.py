"""tessera: a PySpark-native engine for curating query/item text pairs and training corpora."""
