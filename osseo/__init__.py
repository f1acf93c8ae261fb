"""osseo: image-quality analytics for bone-densitometry studies, expressed as Spark DataFrames."""

__version__ = "0.1.0"
