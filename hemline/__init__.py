"""Spark DataFrame operators for product listings and what people write about them."""
