"""Data-quality diagnosis, repair and model readiness as Spark DataFrame operators."""
