"""tidewake: attention-versus-price event studies and bulk text preparation on Spark DataFrames."""

__version__ = "0.1.0"
