"""Training-data operators on Spark tables; nothing else in the package imports them."""
