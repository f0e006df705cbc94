"""serieslab: Spark-native analytics over longitudinal measurements, catalogues and text."""
