"""tessera: anomaly-map scoring, evaluation, stacking and training-data operators on Apache Spark."""
