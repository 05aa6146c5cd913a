"""Pluvio: precipitation nowcasting and forecast verification on Spark DataFrames."""
