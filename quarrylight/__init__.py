"""quarrylight: a Spark-native engine for curating directories and text corpora."""
