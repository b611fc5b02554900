"""pitchlens: in-play match analytics as PySpark DataFrame / Column functions."""

__version__ = "0.1.0"
