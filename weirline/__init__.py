"""weirline: Spark-native preparation and analysis of large text and embedding corpora."""
