"""tidespan: interval-coverage analytics and table hygiene as Spark DataFrame plans."""

__version__ = "0.1.0"
