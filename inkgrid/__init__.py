"""inkgrid: document analytics and vector search as Spark DataFrame transformations."""

__all__ = ["config", "runtime", "schemas"]
