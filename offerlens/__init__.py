"""Listing and offer analytics expressed as Spark DataFrame operators."""
